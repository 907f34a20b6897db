"""Sources and sinks: CSV/Parquet tables in, per-set and per-scale result files out."""

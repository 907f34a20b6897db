"""Batch jobs: read → bootstrap → write, as one Spark application each.

The reference runs one process per category set or per scale and merges files
afterwards. Here every set (or scale) is part of one plan; the result is
materialised once in the shared checkpoint folder, then written file by file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from bootframe.operators.columns import as_sets, string_columns
from bootframe.operators.slicing import pick_slice
from bootframe.plans.bootstrap import DEFAULT_SCALES, boot_cohens_d, boot_stats_sets, resolve_scales
from bootframe.session import cut_lineage
from bootframe.sources.paths import join
from bootframe.sources.sinks import merge_results, write_by_scale, write_sets
from bootframe.sources.tables import read_table


def run_boot_job(
    spark: SparkSession,
    path: str | Sequence[str],
    output_dir: str,
    categories: Sequence[str | Sequence[str]] | None = None,
    key: str = "RID",
    scales: str | Sequence[str] = DEFAULT_SCALES,
    n_iter: int = 1000,
    seed: int = 42,
    method: str = "exact",
    shared: bool = True,
    tasks: int = 1,
    task: int = 1,
    schema=None,
    collapse: bool = False,
    ci: float = 0.95,
) -> list[str]:
    """Grouped percentile bootstrap for many category sets; one ``boot_<set>.csv`` per set.

    ``categories`` default: every string column except ``key``. With ``tasks``
    > 1 only the ``task``-th slice (1-based rank) of the sets is computed.
    ``collapse=True`` bootstraps value cells instead of rows (discrete scores).
    """
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    df = read_table(spark, path, schema=schema)
    if key not in df.columns:
        raise ValueError(f"key column {key!r} not found")
    if categories:
        sets = as_sets(categories)
    else:
        sets = [[c] for c in string_columns(df) if c != key]
    if tasks > 1:
        sets = pick_slice(spark, sets, tasks, task)
        if not sets:
            return []
    measures = resolve_scales(df, scales)
    result = boot_stats_sets(
        df, sets, key, measures, n_iter=n_iter, seed=seed, method=method, shared=shared, collapse=collapse, ci=ci
    )
    result = cut_lineage(result)
    return write_sets(result, output_dir, sets)


def run_cohens_d_job(
    spark: SparkSession,
    path: str | Sequence[str],
    output_dir: str,
    scales: Sequence[str],
    group: str = "gender",
    key: str = "row_id",
    n_iter: int = 1000,
    seed: int = 42,
    merged_name: str | None = "combined.csv",
    schema=None,
    method: str = "exact",
    collapse: bool = False,
    levels: Sequence | None = None,
    na: str = "propagate",
    conf: float = 0.95,
):
    """Cohen's d with basic intervals for every scale: ``<scale>_by_<group>.csv`` each, plus a merged file."""
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    df = read_table(spark, path, schema=schema)
    result = cut_lineage(
        boot_cohens_d(df, list(scales), group, key, n_iter=n_iter, seed=seed, method=method, collapse=collapse,
                      levels=levels, na=na, conf=conf)
    )
    files = write_by_scale(result, output_dir, group, list(scales))
    if merged_name:
        merge_results(spark, files, join(output_dir, merged_name))
    return result

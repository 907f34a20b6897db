"""Table sources: CSV (plain or gzip, one or many files) and Parquet."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bootframe.session import parallelism
from bootframe.sources.paths import children, expand

#: the reference's missing-value tokens
NULL_TOKENS = ("NA", "")


def _is_parquet(spark: SparkSession, path: str) -> bool:
    return path.endswith(".parquet") or any(f.endswith(".parquet") for f in children(spark, path))


def _retype(text: DataFrame, tokens: Sequence[str], inferred: dict, parse_dates: bool) -> DataFrame:
    """Null ``tokens`` in all-text columns, then give each column the narrowest of long / double / text.

    Columns inference already typed (no token could appear in them) keep that type. The
    type checks run over all rows.
    """

    def null_tokens(frame: DataFrame) -> DataFrame:
        return frame.select(*[F.when(~F.col(c).isin(list(tokens)), F.col(c)).alias(c) for c in frame.columns])

    nulled = null_tokens(text)
    candidates = [c for c in text.columns if isinstance(inferred[c], T.StringType)]
    checks = []
    for j, c in enumerate(candidates):
        checks += [
            F.count(F.col(c)).alias(f"n{j}"),
            F.count(F.expr(f"try_cast(`{c}` AS BIGINT)")).alias(f"l{j}"),
            F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"d{j}"),
        ]
    row = nulled.agg(*checks).first() if checks else None
    out = []
    for c in text.columns:
        t = inferred[c]
        if c in candidates:
            j = candidates.index(c)
            n = row[f"n{j}"]
            t = T.LongType() if n and row[f"l{j}"] == n else T.DoubleType() if n and row[f"d{j}"] == n else T.StringType()
        elif not parse_dates and isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            t = T.StringType()
        out.append(F.col(c).cast(t).alias(c))
    return nulled.select(*out)


def column_orders(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files behind ``paths`` by their header row, the header of the first path first.

    One job for all files: only the first split of each is read for its first line. A header
    can't span lines. Files without any line are left out.
    """
    at = spark.read.text(list(paths)).where("_metadata.file_block_start = 0")
    at = at.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    heads = at.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    by_head = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    given = [re.sub("^file:/+", "/", p) for p in paths]

    def place(file: str) -> int:
        plain = re.sub("^file:/+", "/", unquote(file))
        return next((i for i, p in enumerate(given) if plain == p or plain.startswith(p + "/")), len(given))

    orders: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(by_head, key=lambda r: min(map(place, r["files"]))):
        names = tuple(next(csv.reader([row["head"].removeprefix("\ufeff")]), []))
        orders.setdefault(names, []).extend(unquote(f) for f in row["files"])
    return orders


#: Types a text column can have, narrowest first, and which values have them.
_NARROWEST = (
    ("int", "try_cast({c} AS INT) IS NOT NULL"),
    ("bigint", "try_cast({c} AS BIGINT) IS NOT NULL"),
    ("double", "try_cast({c} AS DOUBLE) IS NOT NULL"),
    ("date", "{c} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' AND try_cast({c} AS DATE) IS NOT NULL"),
    ("timestamp", "{c} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' AND try_cast({c} AS TIMESTAMP) IS NOT NULL"),
    ("boolean", "lower({c}) IN ('true', 'false')"),
)


def with_common_types(text: DataFrame, parse_dates: bool = True) -> DataFrame:
    """All-text columns as the narrowest type that holds every value of every file.

    Whole numbers, doubles, dates, timestamps and booleans; anything else, or a mixture, and
    columns without a value stay text. One pass over all rows, all columns at once.
    """
    types = [(t, rule) for t, rule in _NARROWEST if parse_dates or t not in ("date", "timestamp")]
    quoted = ["`" + c.replace("`", "``") + "`" for c in text.columns]
    checks = [F.count(F.col(c)).alias(f"n{j}") for j, c in enumerate(quoted)]
    checks += [F.count_if(F.expr(rule.format(c=c))).alias(f"{t}{j}") for j, c in enumerate(quoted) for t, rule in types]
    row = text.agg(*checks).first()
    out = []
    for j, c in enumerate(quoted):
        n = row[f"n{j}"]
        fits = [t for t, _ in types if n and row[f"{t}{j}"] == n]
        out.append((F.col(c).cast(fits[0]) if fits else F.col(c)).alias(text.columns[j]))
    return text.select(*out)


def bound_as_text(reader, orders: dict[tuple[str, ...], list[str]]) -> DataFrame:
    """Files of each column order as text columns, under one another by name."""
    out = None
    for names, files in orders.items():
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in names])
        part = reader.schema(schema).csv(files)
        out = part if out is None else out.unionByName(part)
    return out


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    null_values: Sequence[str] = NULL_TOKENS,
    fmt: str | None = None,
    repartition_gzip: bool = True,
    parse_dates: bool = False,
) -> DataFrame:
    """Read one table from CSV (header row) or Parquet; several paths or a glob give one table.

    CSV: ``NA`` and empty fields (quoted or not) become NULL; further tokens in
    ``null_values`` are nulled in string columns after the read. Types are
    inferred only when no ``schema`` is given (pass one in production: inference
    costs an extra pass). ``.gz`` files are decompressed by name; gzip is not
    splittable, so the rows are spread over the cluster after the read.
    ``parse_dates=False`` keeps date- and time-like text as strings when inferring
    (so such columns stay grouping categories, as text columns are).
    Several CSV files must have the same columns in the same order when a ``schema`` is
    given; without one their columns are matched by name and take the narrowest type that all files fit.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        raise ValueError("no input path given")
    for p in paths:
        if not expand(spark, p):
            raise ValueError(f"input path does not exist: {p}")
    fmt = fmt or ("parquet" if all(_is_parquet(spark, p) for p in paths) else "csv")
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(*paths)
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    if schema is None:
        orders = column_orders(spark, expand(spark, paths)) if len(expand(spark, paths)) > 1 else {}
        if len(orders) > 1:
            first = set(next(iter(orders)))
            if any(set(names) != first for names in orders):
                raise ValueError(f"files have different columns: {[list(names) for names in orders]}")
            text = bound_as_text(spark.read.option("header", True).option("mode", "FAILFAST"), orders)
            keep = [F.when(~F.col(f"`{c}`").isin(list(null_values)), F.col(f"`{c}`")).alias(c) for c in text.columns]
            out = with_common_types(text.select(*keep), parse_dates)
            return out.repartition(parallelism(spark)) if repartition_gzip and any(f.endswith(".gz") for files in orders.values() for f in files) else out
    tokens = list(null_values)
    primary = "NA" if "NA" in tokens else (tokens[0] if tokens else None)
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if primary is not None:
        reader = reader.option("nullValue", primary)
    if "" in tokens and primary is not None:
        reader = reader.option("emptyValue", primary)
    if schema is not None:
        df = reader.schema(schema).option("enforceSchema", False).csv(paths)
    else:
        df = reader.option("inferSchema", True).csv(paths)
    if schema is None:
        if not parse_dates and any(
            isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema.fields
        ):
            as_text = T.StructType(
                [
                    T.StructField(f.name, T.StringType(), True)
                    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
                    else f
                    for f in df.schema.fields
                ]
            )
            df = reader.schema(as_text).csv(paths)
    extra = [t for t in tokens if t not in ("", primary)]
    if extra:
        if schema is None:
            # Tokens beyond the reader's one null marker made their columns text during
            # inference: read as text, null the tokens, then type each column (one pass).
            as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in df.schema.fields])
            df = _retype(reader.schema(as_text).csv(paths), extra, {f.name: f.dataType for f in df.schema.fields},
                         parse_dates)
        else:
            df = df.select(
                *[
                    F.when(~F.col(f.name).isin(extra), F.col(f.name)).alias(f.name)
                    if isinstance(f.dataType, T.StringType)
                    else F.col(f.name)
                    for f in df.schema.fields
                ]
            )
    if repartition_gzip and any(p.endswith(".gz") for p in paths):
        df = df.repartition(parallelism(spark))
    return df

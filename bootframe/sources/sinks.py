"""Result sinks: one CSV per category set, one per scale, and a merged file.

Results are usually small (groups × scales × statistics), so each CSV is a folder with one
part up to ``SINGLE_PART_ROWS`` rows; a larger one (grouping by a very high-cardinality column) has
several. All CSVs of a result are written by one job: rows become CSV lines, go to the task of
their file and part, and the finished parts are renamed. However many files there are, the
result is read twice, once to count each file's rows. Callers materialise it first (``cut_lineage``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bootframe.operators.columns import as_set, set_name
from bootframe.sources.paths import children, delete, expand, join, qualified, replace_folder
from bootframe.sources.tables import bound_as_text, column_orders, with_common_types

# The result files' column names, as the jobs write them. Inside Spark
# plans the dotted names would read as struct fields, so plans use the underscore form.
SET_OUTPUT_NAMES = {"ci95_ll": "ci95.ll", "ci95_ul": "ci95.ul"}
SCALE_OUTPUT_NAMES = {"ci_level": "ci.level", "ci_ll": "ci.ll", "ci_ul": "ci.ul"}


def set_file_name(cols: Sequence[str]) -> str:
    """``boot_<a,b>.csv``; the empty set gives ``boot.csv``."""
    return "boot" + ("_" + set_name(cols) if cols else "") + ".csv"


#: largest result written as one part file
SINGLE_PART_ROWS = 1_000_000


def _write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    out = df.coalesce(1) if df.count() <= SINGLE_PART_ROWS else df
    out.write.mode(mode).option("header", True).csv(path)
    return path


def _header(names: Sequence[str]) -> str:
    return ",".join('"' + n.replace('"', '\\"') + '"' if set(n) & set(',"\r\n') else n for n in names)


def _write_files(result: DataFrame, out_dir: str, by: str, files: dict[str, tuple[str, dict[str, str]]]) -> None:
    """One CSV folder for each value of the column ``by`` that ``files`` names, in one job.

    ``files``: value to (file name, columns and their names in the file). Lines of a file are in text
    order. A value without rows gives a header alone.
    """
    spark = result.sparkSession
    counts = {r[by]: r["n"] for r in result.where(F.col(by).isin(list(files))).groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {v: max(1, -(-counts.get(v, 0) // SINGLE_PART_ROWS)) for v in files}
    number, line, width = (F.lit(None).cast(t) for t in ("int", "string", "int"))
    for i, (value, (_, columns)) in enumerate(files.items()):
        mine = F.col(by) == F.lit(value)
        number = F.when(mine, F.lit(i)).otherwise(number)
        line = F.when(mine, F.to_csv(F.struct(*[F.col(c) for c in columns]))).otherwise(line)
        width = F.when(mine, F.lit(parts[value])).otherwise(width)
    rows = result.where(F.col(by).isin(list(files))).select(number.alias("_file"), width.alias("_width"), line.alias("value"))
    spread = F.pmod(F.xxhash64("value"), F.col("_width")).cast("int")  # by the line alone: a task that runs again deals alike
    rows = rows.select("_file", spread.alias("_part"), F.lit(1).alias("_n"), "value")
    heads = [(i, p, 0, _header(list(columns.values()))) for i, (value, (_, columns)) in enumerate(files.items()) for p in range(parts[value])]
    lines = rows.unionAll(spark.createDataFrame(heads, "_file int, _part int, _n int, value string"))
    lines = lines.repartition("_file", "_part").sortWithinPartitions("_file", "_part", "_n", "value")
    work = join(out_dir, f"_work-{uuid.uuid4().hex}")
    lines.select("_file", "_part", "value").write.partitionBy("_file", "_part").text(work)
    for i, (value, (name, _)) in enumerate(files.items()):
        done = []
        for p in range(parts[value]):
            folder = join(work, f"_file={i}/_part={p}")
            done += [join(folder, f) for f in children(spark, folder) if f.startswith("part-")]
        replace_folder(spark, join(out_dir, name), done, [f"part-{p:05d}.csv" for p in range(len(done))], join(work, f"done-{i}"))
    delete(spark, work)


def write_sets(
    result: DataFrame,
    out_dir: str,
    sets: Sequence[str | Sequence[str]],
    set_col: str = "set",
    rename: dict[str, str] = SET_OUTPUT_NAMES,
) -> list[str]:
    """One CSV folder per category set, holding only that set's key columns, all written by one job."""
    stat_cols = [c for c in result.columns if c not in (set_col,) and c not in _all_keys(sets)]
    asked = [as_set(s) for s in sets]
    files = {set_name(cols): (set_file_name(cols), {c: rename.get(c, c) for c in [*cols, *stat_cols]}) for cols in asked}
    if files:
        _write_files(result, out_dir, set_col, files)
    return [join(out_dir, set_file_name(cols)) for cols in asked]


def _all_keys(sets: Sequence[str | Sequence[str]]) -> list[str]:
    out: list[str] = []
    for s in sets:
        for c in as_set(s):
            if c not in out:
                out.append(c)
    return out


def write_by_scale(
    result: DataFrame,
    out_dir: str,
    group: str,
    scales: Sequence[str],
    rename: dict[str, str] = SCALE_OUTPUT_NAMES,
) -> list[str]:
    """One CSV folder per scale, ``<scale>_by_<group>.csv``, with the reference's column names, all written by one job."""
    columns = {c: rename.get(c, c) for c in result.columns}
    if scales:
        _write_files(result, out_dir, "scale", {s: (f"{s}_by_{group}.csv", columns) for s in scales})
    return [join(out_dir, f"{s}_by_{group}.csv") for s in scales]


def bind_by_name(spark: SparkSession, inputs: Sequence[str]) -> DataFrame:
    """Rows of CSV files with headers under one another, columns matched by name.

    The files may hold their columns in different order but must have the same ones. A column
    gets the narrowest type that every file's values fit: whole numbers beside doubles are
    doubles, numbers beside text are text, as they were written. One job reads all headers,
    one finds the types.
    """
    orders = column_orders(spark, inputs)
    if not orders:
        raise ValueError(f"no header in {list(inputs)}")
    first = next(iter(orders))
    for names, files in orders.items():
        if set(names) != set(first) or len(names) != len(first):
            raise ValueError(f"columns differ: {list(first)} in {orders[first][0]}, {list(names)} in {files[0]}")
    return with_common_types(bound_as_text(spark.read.option("header", True), orders))


def merge_results(spark: SparkSession, inputs: Sequence[str], output: str) -> DataFrame:
    """Row-bind result CSVs (same columns, matched by name) into one new CSV; inputs are left in place.

    Inputs are paths or patterns. The output must not be among the files they name (a
    re-run would read its own earlier output, and empty it first): this is refused
    before anything is written.
    """
    files = expand(spark, list(inputs))
    if not files:
        raise ValueError("nothing to merge")
    target = qualified(spark, output)
    inside = [f for f in files if f == target or f.startswith(target + "/") or target.startswith(f + "/")]
    if inside:
        raise ValueError(f"output path {target} is also an input: {inside[0]}")
    bound = bind_by_name(spark, files)
    _write_csv(bound, output)
    return spark.read.schema(bound.schema).option("header", True).csv(output)

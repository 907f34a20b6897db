"""Splitting a list of category sets into task-sized slices (as a small table)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bootframe.operators.columns import as_set

RULES = ("batched", "ntile")


def sets_frame(spark: SparkSession, sets: Sequence[str | Sequence[str]]) -> DataFrame:
    """(idx, cols) with idx = 0.. in list order."""
    rows = [(i, as_set(s)) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "idx int, cols array<string>")


def slice_sets(spark: SparkSession, sets: Sequence[str | Sequence[str]], tasks: int, rule: str = "ntile") -> DataFrame:
    """(idx, cols, slice) with slice = 1..; every set lands in exactly one slice.

    ``batched``: consecutive chunks of ``len // tasks + len % tasks`` sets (the
    reference's rule; it can yield fewer chunks than tasks). ``ntile``:
    ``ntile(tasks)`` over idx, as even as possible and never more slices than sets.
    The set list is a handful of rows, so the un-partitioned window is fine.
    """
    if tasks < 1:
        raise ValueError("tasks must be at least 1")
    df = sets_frame(spark, sets)
    if rule == "batched":
        size = len(sets) // tasks + len(sets) % tasks
        return df.withColumn("slice", (F.floor(F.col("idx") / F.lit(size)) + 1).cast("int"))
    if rule == "ntile":
        return df.withColumn("slice", F.ntile(tasks).over(Window.orderBy("idx")))
    raise ValueError(f"rule must be one of {RULES}, got {rule!r}")


def pick_slice(
    spark: SparkSession, sets: Sequence[str | Sequence[str]], tasks: int, task: int, rule: str = "ntile"
) -> list[list[str]]:
    """The sets of slice ``task`` (1-based rank of the task, not its raw id); empty if none."""
    rows = slice_sets(spark, sets, tasks, rule).where(F.col("slice") == F.lit(int(task))).orderBy("idx").collect()
    return [list(r["cols"]) for r in rows]

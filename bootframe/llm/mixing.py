"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source's documents are shuffled by a hash and stand in line once an epoch. A document's
virtual finish time is the source's words up to and with it, over the source's weight. Taking
documents in the order of finish times serves every source in proportion to its weight; a
source whose line has run out leaves its share to the rest, so weights are met as far as the
sources reach. The order is cut where the words taken reach the total budget.

Scale: words in front of a document are a prefix sum. Hash order makes equal slices of each
source, so sums of slices are added up first (one small row a slice), and only the order
within a slice is a window. The cut works alike: finish times fall into cells, cells are
added up, and only the cell that holds the budget is divided again, or ordered row by row. A hot source has
more slices than others, never larger ones. Nothing is broadcast by hint; the driver sees
the budget and the sums of at most ``CELLS`` cells at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .store import stored

#: Rows a slice holds on average, and the range of finish times about the cut at most.
SLICE_ROWS = 20_000
#: Ranges of finish times added up at once.
CELLS = 1024


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], percent: int, epochs: int) -> DataFrame:
    """Target words of each source.

    ``sizes``: source, source_size (one row a source). Sources by code point, null last,
    weigh ``weights`` in turn, repeating, and share ``percent`` % of all sizes; a target
    stops at ``epochs`` times its source's size and the excess is shared anew by weight.
    Returns source, source_size, weight, target. Sources without words get target 0.

    With level v, a source gets min(epochs * size, weight * v). Sources run out in the order
    of size / weight, so the level is found at one place of that order by running sums.
    """
    # the rank by code point: as many rows as sources
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * epochs).cast("double").alias("most"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    run = named.select("*", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("full"), F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"), (F.sum("source_size").over(everything) * percent / 100.0).alias("budget"))
    level = (F.col("budget") - F.coalesce("full", F.lit(0.0))) / F.col("open")
    # the first source that doesn't run out at its level fixes it (later ones give lower levels); if all do, everything is taken
    run = run.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("most"), level)).over(everything))
    return run.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), percent: int = 150, epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """How often the mix takes each document, by weighted fair queueing.

    Returns, per input row: id, text_hash, copy (see below), source, size (words),
    source_size, target (its source's words wanted), times (0 to ``epochs``), taken
    (times * size). The words taken of a source come
    within about a document of its target. The hash that shuffles takes ``seed``, the id, the
    source and the size, so reruns agree whatever the partitioning. Rows equal in id, source and text
    share a hash; ``copy`` numbers them from 1 (the one order among them that can be told).
    Documents without words are never taken. A null source is a source of its own; a null
    id or text is a value like any other. An empty table gives an empty result.
    """
    if epochs < 1 or percent < 0 or not weights or min(weights) <= 0:
        raise ValueError("epochs and weights are positive, percent isn't negative")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), word_count(text).alias("size"))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce("source", F.lit("-")), F.col("size").cast("string")))
    rows = stored(rows.withColumn("h", F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")), "mix-rows")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(per_source.select("source", "source_size"), weights, percent, epochs)
    # a source's hash range in equal slices of about SLICE_ROWS rows
    slices = per_source.select(F.col("source").alias("s"), F.ceil(F.col("n") / SLICE_ROWS).cast("long").alias("slices"))
    targets = stored(targets.join(slices, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    tagged = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    tagged = tagged.withColumn("slice", F.least(F.floor(F.col("h") / F.lit(2.0**60) * F.col("slices")).cast("long"), F.col("slices") - 1))
    sums = tagged.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("source").alias("s"), F.col("slice").alias("sl"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "slice").orderBy("h", "id", "text_hash")
    same = Window.partitionBy("source", "slice", "h", "id", "text_hash").orderBy("size")
    tagged = tagged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("copy", F.row_number().over(same))
    lined = tagged.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).withColumn("upto", F.col("upto") + F.col("before"))
    lined = stored(lined.select("id", "text_hash", "copy", "source", "size", "source_size", "weight", "target", "h", "upto"), "mix-lines")

    def finish(epoch: Column) -> Column:
        return (F.col("upto") + epoch * F.col("source_size")) / F.col("weight")

    epoch_numbers = F.sequence(F.lit(0), F.lit(epochs - 1))
    entry = lined.where("size > 0").select("*", F.explode(epoch_numbers).alias("epoch")).withColumn("finish", finish(F.col("epoch")))
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    cut, done = _cut(entry.select("finish", "size"), total)
    whole = F.size(F.filter(epoch_numbers, lambda e: finish(e) < F.lit(cut[0]))) if cut else F.lit(epochs if total else 0)
    extra = F.lit(0)
    if cut:
        # among the entries about the cut: those before the one that passes the budget, and that one if so the budget is met more nearly
        order = Window.orderBy("finish", F.col("source").isNull(), "source", "h", "id", "text_hash", "copy", "epoch")
        edge = entry.where(F.col("finish").between(*cut)).withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(done))
        edge = edge.where(F.col("run") - F.col("size") / 2.0 <= F.lit(float(total))).groupBy("id", "text_hash", "copy", "source").agg(F.count("*").alias("extra")).toDF("i2", "t2", "c2", "s2", "extra")
        lined = lined.join(edge, F.col("id").eqNullSafe(F.col("i2")) & (F.col("text_hash") == F.col("t2")) & (F.col("copy") == F.col("c2")) & F.col("source").eqNullSafe(F.col("s2")), "left")
        extra = F.coalesce("extra", F.lit(0))
    times = F.when(F.col("size") > 0, whole + extra).otherwise(0).cast("int")
    return lined.select(F.col("id").alias(id_col), "text_hash", "copy", F.col("source").alias(source_col), "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def _cut(entries: DataFrame, total: float) -> tuple[tuple[float, float] | None, int]:
    """Finish times (first, last) of a few entries among which the words taken reach ``total``,
    and the words of all entries before; (None, 0) if all entries stay within it.

    Sums over ``CELLS`` equal ranges of finish times show the range that holds the budget;
    it is divided again until it has few entries.
    """
    low, high = entries.agg(F.min("finish"), F.max("finish")).first()
    done = 0
    while low is not None:
        cell = F.floor((F.col("finish") - F.lit(low)) / F.lit((high - low) or 1.0) * (CELLS - 1)).cast("int")
        cells = entries.where(F.col("finish").between(low, high)).groupBy(cell.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).orderBy("cell").collect()
        for c in cells:
            if done + c["words"] >= total:
                break
            done += c["words"]
        else:
            return None, 0
        low, high = c["low"], c["high"]
        if c["n"] <= SLICE_ROWS or low == high:
            return (low, high), done
    return None, 0


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as :func:`mix` takes it (same options)."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    key = F.xxhash64(F.col(id_col), F.col(source_col).cast("string"))
    times = mix(docs, **options).groupBy(key.alias("__key"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("copy", "times"))).alias("__times"))
    plain = docs.withColumn("__k", key).withColumn("__h", F.xxhash64(F.col(text_col).cast("string")))
    met = plain.join(times, (F.col("__k") == F.col("__key")) & (F.col("__h") == F.col("__hash")))
    # rows equal in id, source and text are told apart by their other columns, if at all
    others = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    number = F.row_number().over(Window.partitionBy("__k", "__h").orderBy(*others))
    met = met.withColumn("__n", number).withColumn("__n", F.col("__times")[F.col("__n") - 1]["times"]).where("__n > 0")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__turn")).drop("__turn")

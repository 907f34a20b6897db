"""Bootstrap over collapsed value cells: work proportional to cells × B, not rows × B.

Under Poisson resampling each row gets an independent Poisson(1) weight, so the
total weight of c identical (group, scale, value) rows is Poisson(c). The
replicate distribution of any statistic of one (group, scale) — mean, median,
count — therefore stays the same when rows are first collapsed into cells
``(group keys, scale, value) → c`` and each cell draws one Poisson(c) weight.

The same holds for exact-n resampling (the reference's draws): seen through one
(set, scale), the n draws of a replicate fall on the value cells as
Multinomial(n, c / n), so :func:`multinomial_cell_weights` draws that vector per
replicate (group sizes still vary between replicates, as with row draws): first how many draws
each hash range of cells gets, then, given that number, which cells of the range.

For discrete measures (survey scores, counts, small integer scales) the number of
cells does not grow with the table: a 100 TB table of scores collapses to
thousands of cells in one map-side-combined aggregate, and the bootstrap itself
becomes small. For continuous measures cells ≈ rows and this saves nothing.

Poisson weights are functions of (seed, replicate, cell) in column arithmetic, exact-n ones come from
numpy generators seeded by (seed, set, scale, replicate), so neither depends on partitioning. Statistics of different scales (or sets) get independent weights: intervals are per
(group, scale, stat) and their distributions are unchanged; only the joint dependence across
scales is not kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bootframe.functions.draws import normal_of_piece, poisson_of_piece, poisson_pieces, uniform, zero_below
from bootframe.operators.columns import set_name
from bootframe.session import cut_lineage, parallelism

_MULTI_SALT = 17
#: cells of a hash range, about; a range is one pandas group of exact-n cell draws
RANGE_CELLS = 1 << 16
#: weighted cell rows produced by one pandas call
OUT_CELLS = 1 << 22


def set_cells(df: DataFrame, sets: Sequence[Sequence[str]], scales: Sequence[str], set_col: str = "set") -> DataFrame:
    """(set, keys..., scale, value, c): value counts per (set group, scale).

    Each row is expanded once a scale and counted by all keys of all sets; each set then sums
    these counts over the keys it doesn't use, which are NULL. Both counts are map-side combined.
    """
    all_cols: list[str] = []
    for s in sets:
        for c in s:
            if c not in all_cols:
                all_cols.append(c)
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [F.struct(F.lit(sc).alias("scale"), F.col(sc).cast("double").alias("value")) for sc in scales]
    finest = df.select(*all_cols, F.inline(F.array(*values))).groupBy(*all_cols, "scale", "value").agg(F.count(F.lit(1)).alias("c"))
    arms = [
        F.struct(F.lit(set_name(s)).alias(set_col), *[(F.col(c) if c in s else F.lit(None).cast(types[c])).alias(c) for c in all_cols])
        for s in sets
    ]
    expanded = finest.select(F.inline(F.array(*arms)), "scale", "value", "c")
    return expanded.groupBy(set_col, *all_cols, "scale", "value").agg(F.sum("c").alias("c"))


def _cell_parts(cells: DataFrame) -> list[Column]:
    """What a cell's draws are hashed from: its columns as text ("~" for null)."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cells.columns if c != "c"]


def poisson_cell_weights(cells: DataFrame, n_iter: int, seed: int = 42, hash: str = "xxhash64", rate: float = 1.0) -> DataFrame:
    """Cells × replicates with weight ``w ~ Poisson(rate · c)``: adds ``r`` and ``w``, drops ``c``.

    A small count's weight comes in several rows, one for each of its pieces (none for pieces of weight 0).
    """
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    parts = _cell_parts(cells)
    # the cell table is small by design; spread it so the draws use every core
    reps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(int(n_iter) - 1).cast("bigint")))
    pieces = cells.withColumn("_piece", F.explode(poisson_pieces(F.col("c")))).repartition(2 * parallelism(cells.sparkSession))
    drawn = pieces.select(*[c for c in cells.columns if c != "c"], F.col("_piece.size").alias("_size"), F.col("_piece.tag").alias("_tag"), reps.alias("r"))
    # the uniform and the normal are columns of their own: what reads them often doesn't compute them again
    drawn = drawn.withColumn("_u", uniform(seed, [F.col("r"), *parts, F.col("_tag")], hash))
    # pieces that weigh 0 go by the uniform; a filter on w would be pushed down and draw everything twice
    drawn = drawn.where(F.col("_u") >= zero_below(F.col("_size"), rate))
    drawn = drawn.withColumn("_z", normal_of_piece(F.col("_size"), F.col("_u")))
    return drawn.withColumn("w", poisson_of_piece(F.col("_size"), rate, F.col("_u"), F.col("_z"))).drop("_size", "_tag", "_u", "_z")


def multinomial_cell_weights(
    cells: DataFrame, n_iter: int, seed: int = 42, set_col: str = "set", range_cells: int = RANGE_CELLS
) -> DataFrame:
    """Exact-n replicate weights over cells: per (set, scale) and replicate, Multinomial(n, c / n).

    Adds ``r`` and ``w`` (> 0), drops ``c``. The cells of a (set, scale) are cut into equal ranges of
    their hash, of about ``range_cells`` cells each. One small group a (set, scale) deals a replicate's
    n draws to the ranges, Multinomial(n, range / n); each range, a group of its own, deals
    what it got to its cells, so no number of cells is too large and each (set, scale) takes many
    tasks. Replicates go in chunks, so one pandas call makes about ``OUT_CELLS`` weights. Draws are
    seeded by (seed, set, scale, chunk, range) and cells are ordered by their hash, so
    partitioning does not change them.
    """
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    if range_cells < 1:
        raise ValueError("range_cells must be at least 1")
    cells = cut_lineage(cells)  # read three times
    biggest = cells.groupBy(set_col, "scale").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0]
    if not biggest:
        raise ValueError("no cells to resample")
    bits = (-(-biggest // range_cells) - 1).bit_length()
    step = max(1, min(n_iter, OUT_CELLS // min(biggest, range_cells)))
    keep = [c for c in cells.columns if c != "c"]
    schema = T.StructType([*[f for f in cells.schema.fields if f.name in keep], T.StructField("r", T.LongType()), T.StructField("w", T.LongType())])
    at = [set_col, "scale", "_range", "_chunk"]
    chunk = F.explode(F.sequence(F.lit(0), F.lit(-(-n_iter // step) - 1))).alias("_chunk")
    of = F.xxhash64(F.col(set_col), F.col("scale")).bitwiseAND(F.lit((1 << 63) - 1)).alias("_of")
    h = F.xxhash64(*[F.col(c) for c in keep])
    ranged = cells.select("*", of, h.alias("_h"), (F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint")).alias("_range"))

    def reps(first: int) -> int:
        return min(n_iter, (first + 1) * step) - first * step

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range").reset_index(drop=True)
        n, part = int(pdf["_c"].sum()), int(pdf["_chunk"].iloc[0])
        rng = np.random.default_rng([int(seed), _MULTI_SALT, int(pdf["_of"].iloc[0]), part])
        dealt = rng.multinomial(n, pdf["_c"].to_numpy(np.int64) / n, size=reps(part))
        return pd.DataFrame({**{c: pdf[c] for c in at}, "_draws": list(dealt.T)})

    def draw(pdf: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", kind="stable").reset_index(drop=True)
        counts, part = pdf["c"].to_numpy(dtype=np.int64), int(pdf["_chunk"].iloc[0])
        rng = np.random.default_rng([int(seed), _MULTI_SALT, int(pdf["_of"].iloc[0]), part, 1 + int(pdf["_range"].iloc[0])])
        w = rng.multinomial(np.asarray(dealt["_draws"].iloc[0], np.int64), counts / counts.sum())
        r, idx = np.nonzero(w)
        out = {c: pdf[c].to_numpy()[idx] for c in keep}
        return pd.DataFrame({**out, "r": r + part * step, "w": w[r, idx]}, columns=[*keep, "r", "w"])

    ranges = ranged.groupBy(set_col, "scale", "_of", "_range").agg(F.sum("c").alias("_c")).select("*", chunk)
    dealt = ranges.groupBy(set_col, "scale", "_chunk").applyInPandas(deal, ranges.select(*at).withColumn("_draws", F.lit(None).cast("array<bigint>")).schema)
    return ranged.select("*", chunk).groupBy(*at).cogroup(dealt.groupBy(*at)).applyInPandas(draw, schema)

"""Exact-n resampling without moving the n·B draws.

Every replicate draws exactly ``n`` rows uniformly with replacement, as in the reference, in two parts:

1. *In place.* Each row weighs Poisson(rate) by the inverse CDF of ``hash(seed, r, key)``, with a
   rate a little below 1 (:func:`base_rate`). Nothing moves. Given their sum S, the weights are
   Multinomial(S, 1/n).
2. *Topped up.* The ``n - S`` missing draws of each replicate, about ``RESERVE`` · sqrt(n) of them,
   pick rows by ``hash(seed, r, s) mod n`` and meet the rows on a dense index. Added to the
   weights of part 1 they are Multinomial(n, 1/n), exactly, whatever S.

A replicate with S > n can't be topped up; that happens about once in 10^9 replicates, and then
the whole run is drawn anew (which depends on S alone, so the distribution stays exact).
Weights are functions of (seed, r, key) and of the row's number, never of the partitioning; both parts
work on any subset of the rows. For small n the rate is 0 and part 2 draws all. The driver
sees one number a replicate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootframe.functions.draws import hash_bits
from bootframe.operators.resample import key_columns, poisson_rows, row_index
from bootframe.session import cut_lineage

#: standard deviations that part 1 stays below n on average
RESERVE = 6.0
#: seeds of further runs are this far apart
SEED_STEP = 1_000_003


def base_rate(n: int) -> float:
    """Rate of the draws in place: their sum exceeds ``n`` about once in 10^9 replicates."""
    return max(0.0, 1.0 - RESERVE / n**0.5)


@dataclass(frozen=True)
class ExactN:
    """Exact-n weights of ``n_iter`` replicates, ready to be put on rows (or on some of them)."""

    n: int
    keys: list[str]
    n_iter: int
    seed: int
    hash: str
    extra: DataFrame  # (r, i, w): the draws that top up
    index_col: str = "i"

    def weigh(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with the keys and the row number) with ``r`` and ``w`` > 0; a row may come twice
        in a replicate, once from each part: its weight is the sum."""
        placed = poisson_rows(rows, self.keys, self.n_iter, self.seed, self.hash, base_rate(self.n))
        topped = rows.join(self.extra, self.index_col).select(*rows.columns, "r", "w")
        return placed.select(*rows.columns, "r", "w").unionByName(topped)


def exact_n(indexed: DataFrame, n: int, keys: Sequence[str], n_iter: int, seed: int = 42, hash: str = "xxhash64", index_col: str = "i") -> ExactN:
    """Plan the weights of the ``n`` rows of ``indexed`` (unique keys, numbers 0..n-1)."""
    spark = indexed.sparkSession
    while True:
        placed = poisson_rows(indexed.select(*keys), keys, n_iter, seed, hash, base_rate(n))
        sums = {row["r"]: int(row["s"]) for row in placed.groupBy("r").agg(F.sum("w").alias("s")).collect()}
        if max(sums.values(), default=0) <= n:
            break
        seed += SEED_STEP
    missing = spark.createDataFrame([(r, n - sums.get(r, 0)) for r in range(n_iter)], "r long, missing long")
    draws = missing.where("missing > 0").repartition(min(n_iter, 64)).select("r", F.explode(F.expr("sequence(0L, missing - 1)")).alias("s"))
    at = F.pmod(hash_bits(seed, [F.col("r"), F.col("s"), F.lit("top")], hash), F.lit(int(n)).cast("bigint"))
    extra = cut_lineage(draws.select("r", at.alias(index_col)).groupBy("r", index_col).agg(F.count(F.lit(1)).alias("w")))
    return ExactN(n, list(keys), n_iter, seed, hash, extra, index_col)


def multinomial_resample(df: DataFrame, key: str | Sequence[str], n_iter: int, seed: int = 42, hash: str = "xxhash64") -> DataFrame:
    """Weighted replicate rows (``df``'s columns + ``r``, ``w``) for exact-n resamples; see :class:`ExactN`."""
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    keys = key_columns(key)
    idx = row_index(df, keys, hash=hash)
    rows = cut_lineage(idx.df)
    return exact_n(rows, idx.n, keys, n_iter, seed, hash).weigh(rows).drop(idx.index_col)

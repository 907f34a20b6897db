"""Resampling with replacement, expressed as weights instead of copied rows.

A bootstrap replicate ``r`` is a multiset of rows. It is carried as a
frequency ``w`` per drawn row, with ``r`` as a column, so all replicates
run in one plan and no row is ever duplicated in memory.

* ``method="exact"`` (the reference's semantics): every replicate draws
  exactly ``n`` row indices uniformly with replacement. Draw ``s`` of
  replicate ``r`` picks ``i = hash(seed, r, s) mod n``. The draws meet the
  data on a dense row index ``i`` (see :func:`row_index`).
* ``method="multinomial"``: exact-n like ``"exact"`` (same distribution, other
  realisation), but rows weigh themselves in place and only some sqrt(n) draws a
  replicate move, to make up n (:mod:`bootframe.operators.multinomial`).
* ``method="poisson"``: every row gets an independent Poisson(1) weight from
  ``hash(seed, r, key)``. Same limiting distribution, no row index, no join,
  no shuffle before the aggregate: the plan to use at very large scale.

Nothing here uses ``rand()``: draws are pure functions of their inputs, so a
recomputed partition (after executor loss) yields identical weights, and the
result is the same for any partitioning.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bootframe.session import cut_lineage, input_partitions, parallelism
from bootframe.functions.draws import draw_index, md5_bits, poisson_thresholds, poisson_weight, uniform

METHODS = ("exact", "multinomial", "poisson")

#: rows per index bucket: one bucket is numbered by a single window task
ROWS_PER_BUCKET = 1 << 18
#: draws generated per task of the exact draw range
DRAWS_PER_TASK = 1 << 23
#: draws packed at once, and draws of a bucket's rows, when they are shuffled
DRAWS_PER_GROUP = 1 << 21
#: draws per partition of the packed draws
WEIGHTS_PER_PARTITION = 1 << 26
#: largest proven in-memory size of the indexed table that may be broadcast
BROADCAST_LIMIT = 256 << 20


@dataclass(frozen=True)
class Indexed:
    """A table with a dense row index ``index_col`` = 0..n-1 and a proven size bound."""

    df: DataFrame
    n: int
    size_bound: int
    index_col: str = "i"


def key_columns(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def size_profile(df: DataFrame) -> tuple[int, int]:
    """One pass: ``(rows, proven upper bound of the rows' in-memory bytes)``.

    UnsafeRow layout: a null bitmap word per 64 fields, 8 bytes per field, and
    variable-length payloads rounded up to 8 bytes. String and binary payloads
    are measured exactly (``octet_length``); other types count 8 bytes.
    """
    var_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    aggs = [F.count(F.lit(1)).alias("n")]
    for j, c in enumerate(var_cols):
        aggs.append(F.sum(F.ceil(F.coalesce(F.octet_length(F.col(c)), F.lit(0)) / F.lit(8)) * 8).alias(f"v{j}"))
    row = df.agg(*aggs).first()
    n = int(row["n"])
    var_bytes = sum(int(row[f"v{j}"] or 0) for j in range(len(var_cols)))
    nfields = len(df.columns) + 1  # + the index column
    fixed = 8 * ((nfields + 63) // 64) + 8 * nfields
    return n, n * fixed + var_bytes


def row_index(
    df: DataFrame,
    key: str | Sequence[str],
    index_col: str = "i",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    hash: str = "xxhash64",
) -> Indexed:
    """Number the rows densely 0..n-1 by key: ``row_number() OVER (ORDER BY key) - 1``,
    whatever the size.

    More than ``rows_per_bucket`` rows are dealt into ranges of the key, kept as a table
    in the shared checkpoint folder (so the ranges can't change under a retry); the
    row counts of the ranges give each its offset, and within a range ``row_number()``
    by key. The numbers don't depend on where ranges are cut.

    Never ``monotonically_increasing_id``: it changes with the partitioning.
    """
    keys = key_columns(key)
    # Key first, then every other column: ties (a repeated key) are broken by the
    # row's content, so the numbering is deterministic up to fully identical rows.
    order = [*keys, *[c for c in df.columns if c not in keys]]
    n, bound = size_profile(df)
    if n == 0:
        raise ValueError("cannot resample an empty table")
    p = max(1, math.ceil(n / rows_per_bucket))
    if p == 1:
        # At most rows_per_bucket rows: one window task numbers them all.
        ranked = df.withColumn(index_col, (F.row_number().over(Window.orderBy(*order)) - F.lit(1)).cast("bigint"))
        return Indexed(ranked, n, bound, index_col)
    with_b = cut_lineage(df.repartitionByRange(p, *order).withColumn("_bucket", F.spark_partition_id()))
    offsets = (
        with_b.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(
            "_bucket",
            F.coalesce(
                F.sum("_cnt").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    # offsets has at most P rows (P = ceil(n / rows_per_bucket)): a proven small side.
    ranked = with_b.join(F.broadcast(offsets), "_bucket").withColumn(
        index_col,
        (F.col("_offset") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - F.lit(1)).cast(
            "bigint"
        ),
    )
    return Indexed(ranked.drop("_bucket", "_offset"), n, bound, index_col)


def check_unique_key(df: DataFrame, keys: Sequence[str]) -> None:
    """Refuse a repeated key (Poisson weights hash the key: repeats would share weights).

    Exact: one grouping by the key columns alone (combined before its shuffle).
    """
    again = df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").take(1)
    if again:
        raise ValueError(f"key {list(keys)} is not unique: {again[0]['_n']} rows have {list(again[0])[:-1]}")


def exact_draws(
    spark: SparkSession, n: int, n_iter: int, seed: int = 42, hash: str = "xxhash64", draws_per_task: int = DRAWS_PER_TASK
) -> DataFrame:
    """All draws of all replicates: ``(r, i)``, ``n`` rows per replicate, generated in parallel."""
    total = int(n) * int(n_iter)
    parts = max(2 * parallelism(spark), math.ceil(total / draws_per_task))
    ids = spark.range(0, total, 1, parts)
    r = F.expr(f"id div {int(n)}")  # integral division: exact for any id
    s = F.expr(f"id % {int(n)}")
    return ids.select(r.alias("r"), s.alias("s")).select("r", draw_index(seed, F.col("r"), F.col("s"), n, hash).alias("i"))


def exact_weights(
    spark: SparkSession, n: int, n_iter: int, seed: int = 42, hash: str = "xxhash64", partitions: int | None = None
) -> DataFrame:
    """The weight table ``(r, i, w)``: how often row ``i`` is drawn in replicate ``r`` (w > 0, Σw = n per r).

    Partitioned by ``i`` so that a join on the row index needs no further exchange.
    """
    draws = exact_draws(spark, n, n_iter, seed, hash)
    if partitions:
        draws = draws.repartition(partitions, "i")
    return draws.groupBy("i", "r").agg(F.count(F.lit(1)).alias("w")).select("r", "i", "w")


def poisson_weight_column(seed: int, r: Column, key_cols: Sequence[Column], hash: str = "xxhash64") -> Column:
    """Poisson(1) weight of the row with key ``key_cols`` in replicate ``r``."""
    return poisson_weight(uniform(seed, [r, *key_cols], hash))


def poisson_rows(df: DataFrame, keys: Sequence[str], n_iter: int, seed: int = 42, hash: str = "xxhash64", rate: float = 1.0) -> DataFrame:
    """``df``'s rows with ``r`` and the Poisson(rate) weight ``w`` > 0 of their key in replicate ``r``."""
    # Each input row becomes n_iter weighted rows inside its task: the rows are dealt to as
    # many tasks as their draws need, and a small input at least over the cores.
    cores = parallelism(df.sparkSession)
    if n_iter > 1 and not df.isStreaming:
        have, need = input_partitions(df, cores), math.ceil(df.count() * n_iter / DRAWS_PER_TASK)
        if have < max(cores, need):
            df = df.repartition(max(2 * cores, need))
    reps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(int(n_iter) - 1).cast("bigint")))
    weighted = df.select("*", reps.alias("r"))
    # Bind the hash once: the CASE chain reads the column, not 18 copies of the hash.
    # w > 0 ⇔ u ≥ P(X = 0), so rows of weight 0 are dropped before the CASE runs.
    weighted = weighted.withColumn("_u", uniform(seed, [F.col("r"), *[F.col(k) for k in keys]], hash))
    weighted = weighted.where(F.col("_u") >= F.lit((poisson_thresholds(rate) or [1.0])[0]))
    return weighted.withColumn("w", poisson_weight(F.col("_u"), rate)).drop("_u")


def resample(
    df: DataFrame,
    key: str | Sequence[str],
    n_iter: int,
    seed: int = 42,
    method: str = "exact",
    hash: str = "xxhash64",
    broadcast_limit: int | None = None,
    indexed: Indexed | None = None,
    assume_unique: bool = False,
) -> DataFrame:
    """Weighted replicate rows: ``df``'s columns plus ``r`` (replicate) and ``w`` (frequency > 0).

    exact, indexed table within ``broadcast_limit`` (proven size): the draws
    stream through a broadcast hash join, one row per draw with ``w = 1``; no
    shuffle before the caller's aggregate.
    exact, larger table: the draws are sent to the rows as a byte or so each and
    counted there (:func:`packed_resample`).
    multinomial: exact-n, drawn in place and topped up by a few draws that are joined.
    poisson: ``explode`` the replicate numbers and weight each row in place. The key is
    checked to be unique first; ``assume_unique=True`` skips that.
    """
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    spark = df.sparkSession
    keys = key_columns(key)
    if method == "poisson":
        if not assume_unique:
            check_unique_key(df, keys)
        return poisson_rows(df, keys, n_iter, seed, hash)
    if method == "multinomial":
        from bootframe.operators.multinomial import multinomial_resample

        return multinomial_resample(df, keys, n_iter, seed, hash)
    idx = indexed or row_index(df, keys, hash=hash)
    limit = BROADCAST_LIMIT if broadcast_limit is None else broadcast_limit
    if 2 * idx.size_bound <= limit:
        draws = exact_draws(spark, idx.n, n_iter, seed, hash)
        joined = draws.join(F.broadcast(idx.df), idx.index_col)
        return joined.drop(idx.index_col).withColumn("w", F.lit(1).cast("bigint"))
    warnings.warn(
        f"exact draws for {idx.n} rows exceed the broadcast bound and will be shuffled "
        f"({idx.n * n_iter} draws); method='multinomial' draws exact-n samples in place",
        stacklevel=2,
    )
    return packed_resample(idx, n_iter, seed, hash)


def pack(offsets: np.ndarray) -> bytes:
    """Sorted numbers from 0 as their differences, a byte each (255: that far and on)."""
    steps = np.diff(offsets, prepend=0)
    more = steps // 255
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1, 255, np.uint8)
    out[ends] = steps % 255
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _packed(rows_per_bucket: int, draws: int, seed: int, n: int):
    """Packs draws: columns r and i, or, where a row names a range of draws (first, last), those of md5."""

    def packs(r: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        out: tuple[list, list, list] = [], [], []
        for one in np.unique(r):
            mine = np.sort(i[r == one])
            cuts = np.flatnonzero(np.diff(mine // rows_per_bucket)) + 1
            for part in np.split(mine, cuts):
                bucket = int(part[0]) // rows_per_bucket
                for column, value in zip(out, (bucket, int(one), pack(part - bucket * rows_per_bucket))):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["_bucket", "_r", "_draws"])

    def drawn(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if "i" in batch.schema.names:
            yield batch.column("r").to_numpy(), batch.column("i").to_numpy()
            return
        for at, last in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist()):
            while at < last:
                r, s = divmod(at, n)
                end = min(last, at + draws, (r + 1) * n)
                yield np.full(end - at, r), md5_bits(seed, r, s, s + end - at) % n
                at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rs, ats, held = [], [], 0
        for batch in batches:
            for r, i in drawn(batch):
                rs.append(r)
                ats.append(i)
                held += len(i)
                if held >= draws:
                    yield packs(np.concatenate(rs), np.concatenate(ats))
                    rs, ats, held = [], [], 0
        if held:
            yield packs(np.concatenate(rs), np.concatenate(ats))

    return run


def _weighed(columns: list[str], rows_per_bucket: int):
    def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
        place = rows.column("_at").to_numpy() % rows_per_bucket
        where = np.zeros(rows_per_bucket, np.int64)
        where[place] = np.arange(len(place))
        of: dict[int, list[bytes]] = {}
        for r, packed in zip(draws.column("_r").to_pylist(), draws.column("_draws").to_pylist()):
            of.setdefault(r, []).append(packed)
        at, r_of, w_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r, parts in of.items():
            counts = np.bincount(np.concatenate([unpack(x) for x in parts]))
            drawn = np.flatnonzero(counts)
            at.append(where[drawn])
            r_of.append(np.full(len(drawn), r))
            w_of.append(counts[drawn])
        out = rows.select([f"_{j}" for j in range(len(columns))]).take(pa.array(np.concatenate(at)))
        return pa.Table.from_arrays([*out.columns, pa.array(np.concatenate(r_of)), pa.array(np.concatenate(w_of).astype(np.int64))], [*columns, "r", "w"])

    return run


def packed_resample(idx: Indexed, n_iter: int, seed: int = 42, hash: str = "xxhash64") -> DataFrame:
    """:func:`resample` of a table of any size, exact method: the draws go to their rows as some byte each.

    Rows with neighbouring numbers are a bucket. A task sorts its draws of a replicate and sends
    each bucket their differences (:func:`pack`); there they are counted and meet the bucket's
    rows. Memory: ``DRAWS_PER_GROUP`` draws, and as many weighted rows of one bucket.
    """
    spark = idx.df.sparkSession
    rows_per_bucket = max(1, DRAWS_PER_GROUP // n_iter)
    # Sized by the draws (a byte each): AQE cannot split a repartition.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(idx.n * n_iter / WEIGHTS_PER_PARTITION))
    if hash == "md5":
        # the same draws as exact_draws, hashed by the array: as a column md5 makes a string of each
        total = idx.n * n_iter
        tasks = max(2 * parallelism(spark), math.ceil(total / DRAWS_PER_TASK))
        share = math.ceil(total / tasks)
        made = spark.range(0, tasks, 1, tasks).select((F.col("id") * share).alias("first"), F.least((F.col("id") + 1) * share, F.lit(total)).alias("last"))
    else:
        made = exact_draws(spark, idx.n, n_iter, seed, hash)
    draws = made.mapInArrow(_packed(rows_per_bucket, DRAWS_PER_GROUP, int(seed), idx.n), "_bucket long, _r long, _draws binary")
    fields = [f for f in idx.df.schema.fields if f.name != idx.index_col]
    rows = idx.df.select(F.expr(f"`{idx.index_col}` div {rows_per_bucket}").alias("_bucket"), F.col(idx.index_col).alias("_at"), *[F.col(f"`{f.name}`").alias(f"_{j}") for j, f in enumerate(fields)])
    schema = T.StructType([*fields, T.StructField("r", T.LongType()), T.StructField("w", T.LongType())])
    both = [x.repartition(parts, "_bucket").groupBy("_bucket") for x in (rows, draws)]
    return both[0].cogroup(both[1]).applyInArrow(_weighed([f.name for f in fields], rows_per_bucket), schema)

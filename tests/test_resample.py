from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bootframe.operators.resample import exact_weights, resample, row_index
from tests.brute import md5_draw


def test_weights_sum_to_n_per_replicate(spark):
    w = exact_weights(spark, 97, 30, seed=42, hash="xxhash64")
    totals = {r["r"]: r["t"] for r in w.groupBy("r").agg(F.sum("w").alias("t")).collect()}
    assert sorted(totals) == list(range(30))
    assert set(totals.values()) == {97}
    assert w.where(F.col("w") <= 0).count() == 0


def test_md5_draws_match_python(spark):
    w = exact_weights(spark, 50, 3, seed=42, hash="md5").collect()
    got = {(r["r"], r["i"]): r["w"] for r in w}
    want: dict = {}
    for r in range(3):
        for s in range(50):
            k = (r, md5_draw(42, r, s, 50))
            want[k] = want.get(k, 0) + 1
    assert got == want


def test_weights_independent_of_partitioning(spark):
    a = exact_weights(spark, 200, 5, hash="xxhash64", partitions=1)
    b = exact_weights(spark, 200, 5, hash="xxhash64", partitions=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_row_index_dense_single_and_many_buckets(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 + 3).alias("k"), F.col("id").alias("v"))
    one = row_index(df, "k")
    assert one.n == 1000
    got = {r["k"]: r["i"] for r in one.df.collect()}
    assert got == {k: j for j, k in enumerate(sorted(got))}
    many = row_index(df, "k", rows_per_bucket=64)
    for per_bucket in (400, 64, 30, 1):  # the numbers don't depend on the buckets
        assert {r["k"]: r["i"] for r in row_index(df, "k", rows_per_bucket=per_bucket).df.collect()} == got
    # deterministic for another partitioning of the input
    again = row_index(df.repartition(5), "k", rows_per_bucket=64)
    assert sorted((r["k"], r["i"]) for r in many.df.collect()) == sorted((r["k"], r["i"]) for r in again.df.collect())


def test_poisson_weights_moments(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"))
    rows = resample(df, "k", 50, method="poisson")
    stats = rows.agg(F.sum("w").alias("s")).first()["s"]
    mean = stats / (2000 * 50)
    assert abs(mean - 1.0) < 0.02
    # per-row weights over replicates: variance close to 1
    per = rows.groupBy("k").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2")).collect()
    tot = sum(r["sw"] for r in per)
    tot2 = sum(r["sw2"] for r in per)
    var = tot2 / (2000 * 50) - (tot / (2000 * 50)) ** 2
    assert abs(var - 1.0) < 0.05


def test_exact_resample_shuffle_path_equals_broadcast_path(spark):
    df = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    small = resample(df, "k", 4, hash="md5")
    big = resample(df, "k", 4, hash="md5", broadcast_limit=0)
    a = sorted(tuple(r) for r in small.groupBy("r", "k").agg(F.sum("w").alias("w")).collect())
    b = sorted(tuple(r) for r in big.select("r", "k", "w").collect())
    assert a == b


def test_poisson_refuses_repeated_key(spark):
    import pytest

    df = spark.range(0, 1000).select((F.col("id") % 10).alias("k"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError):
        resample(df, "k", 3, method="poisson")


def test_exact_index_deterministic_with_repeated_key(spark):
    # key repeats, rows differ: the index orders ties by content, for any partitioning
    df = spark.range(0, 500).select((F.col("id") % 50).alias("k"), F.col("id").cast("double").alias("x"))
    a = row_index(df, "k").df
    b = row_index(df.repartition(6), "k").df
    assert sorted((r["i"], r["x"]) for r in a.collect()) == sorted((r["i"], r["x"]) for r in b.collect())


def test_multi_bucket_index_same_weights_on_both_join_strategies(spark):
    df = spark.range(0, 900).select((F.col("id") * 13 % 901).alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    idx = row_index(df, "k", rows_per_bucket=100)  # P = 9 buckets
    small = resample(df, "k", 5, hash="md5", indexed=idx)
    big = resample(df, "k", 5, hash="md5", indexed=idx, broadcast_limit=0)
    a = sorted(tuple(r) for r in small.groupBy("r", "k").agg(F.sum("w").alias("w")).collect())
    b = sorted(tuple(r) for r in big.select("r", "k", "w").collect())
    assert a == b
    assert {r["t"] for r in big.groupBy("r").agg(F.sum("w").alias("t")).collect()} == {900}


def test_key_with_few_repeats_is_refused_unless_assumed_unique(spark):
    df = spark.range(0, 1000).select((F.col("id") % 920).alias("k"), F.col("id").alias("v"))
    with pytest.raises(ValueError):
        resample(df, "k", 2, method="poisson")
    assert resample(df, "k", 2, method="poisson", assume_unique=True).count() > 0


def test_packed_numbers_come_back_whatever_their_distance():
    from bootframe.operators.resample import pack, unpack

    for numbers in ([0], [7, 7, 7], [254, 255, 256, 766, 767, 5000], [510], list(range(0, 90_000, 255))):
        assert unpack(pack(np.array(numbers))).tolist() == numbers


def test_shuffled_draws_are_sent_as_bytes_and_counted_at_their_rows(spark, monkeypatch):
    from bootframe.operators import resample as R

    monkeypatch.setattr(R, "DRAWS_PER_GROUP", 64)
    rows = [(i, None if i % 5 == 0 else f"g{i % 3}", i * 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "r_key long, g string, x double")
    with pytest.warns(UserWarning):
        big = resample(df, "r_key", 6, hash="md5", broadcast_limit=0)
    want = Counter((r["r"], r["r_key"], r["g"], r["x"]) for r in resample(df, "r_key", 6, hash="md5").collect())
    got = big.collect()
    assert {(x["r"], x["r_key"], x["g"], x["x"]): x["w"] for x in got} == dict(want) and len(got) == len(want)
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_draws" in plan and "Join" not in plan


def test_poisson_rows_are_dealt_by_their_draws(spark, monkeypatch):
    from bootframe.operators import resample as R

    df = spark.range(1000).toDF("k")
    before = {(x["k"], x["r"]): x["w"] for x in R.poisson_rows(df, ["k"], 50).collect()}
    monkeypatch.setattr(R, "DRAWS_PER_TASK", 500)
    out = R.poisson_rows(df, ["k"], 50)
    assert out.rdd.getNumPartitions() == 100
    assert {(x["k"], x["r"]): x["w"] for x in out.collect()} == before

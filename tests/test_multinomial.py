import pytest
from pyspark.sql import functions as F

from bootframe.operators.multinomial import base_rate, multinomial_resample
from bootframe.plans.bootstrap import boot_stats


def test_weights_sum_to_n_and_ignore_partitioning(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 11).cast("double").alias("x"))
    a = multinomial_resample(df, "k", 20, seed=5)
    totals = a.groupBy("r").agg(F.sum("w").alias("t")).collect()
    assert sorted(r["r"] for r in totals) == list(range(20))
    assert {r["t"] for r in totals} == {3000}
    b = multinomial_resample(df.repartition(7), "k", 20, seed=5)
    total = lambda df: df.groupBy("r", "k").agg(F.sum("w").alias("w")).collect()
    key = lambda df: sorted((r["r"], r["k"], r["w"]) for r in total(df))
    assert key(a) == key(b)


def test_row_weight_moments(spark):
    n, B = 2000, 60
    df = spark.range(0, n).select(F.col("id").alias("k"))
    rows = multinomial_resample(df, "k", B)
    rows = rows.groupBy("r", "k").agg(F.sum("w").alias("w"))
    per = rows.groupBy("k").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2")).collect()
    mean = sum(r["s"] for r in per) / (n * B)
    var = sum(r["s2"] for r in per) / (n * B) - mean**2
    assert mean == pytest.approx(1.0, abs=1e-12)  # exactly n draws per replicate
    assert var == pytest.approx(1 - 1 / n, abs=0.05)  # Binomial(n, 1/n) marginal


def test_boot_stats_multinomial_close_to_exact(spark, survey):
    a = {(r["smoke"], r["stat"]): r for r in boot_stats(survey, "smoke", "RID", ["IPIP50_agree"], n_iter=200).collect()}
    b = {(r["smoke"], r["stat"]): r for r in boot_stats(survey, "smoke", "RID", ["IPIP50_agree"], n_iter=200,
                                                         method="multinomial").collect()}
    assert a.keys() == b.keys()
    for k in a:
        if k[0] == "rare":
            continue
        width_a = a[k]["ci95_ul"] - a[k]["ci95_ll"]
        width_b = b[k]["ci95_ul"] - b[k]["ci95_ll"]
        assert a[k]["median"] == pytest.approx(b[k]["median"], abs=0.15)
        assert width_b == pytest.approx(width_a, rel=0.35)


def test_small_tables_are_drawn_whole_and_large_ones_topped_up(spark):
    assert base_rate(36) == 0 and 0 < base_rate(37) < base_rate(10**10) < 1
    for n in (1, 5, 36, 400):
        rows = multinomial_resample(spark.range(0, n).select(F.col("id").alias("k")), "k", 30)
        totals = rows.groupBy("r").agg(F.sum("w").alias("t")).collect()
        assert len(totals) == 30 and {r["t"] for r in totals} == {n}


def test_a_replicate_over_n_draws_the_run_anew(spark, monkeypatch):
    from bootframe.operators import multinomial

    # rate 1: half of the replicates exceed n, so runs of two replicates are drawn until none does
    monkeypatch.setattr(multinomial, "base_rate", lambda n: 1.0)
    rows = multinomial.multinomial_resample(spark.range(0, 300).select(F.col("id").alias("k")), "k", 2)
    assert {r["t"] for r in rows.groupBy("r").agg(F.sum("w").alias("t")).collect()} == {300}


def test_some_rows_get_the_weights_they_have_among_all(spark):
    from bootframe.operators.multinomial import exact_n

    rows = spark.range(0, 500).select(F.col("id").alias("k"), F.col("id").alias("i"))
    plan = exact_n(rows, 500, ["k"], 10)
    total = lambda df: {(r["r"], r["k"]): r["w"] for r in df.groupBy("r", "k").agg(F.sum("w").alias("w")).collect()}
    every, some = total(plan.weigh(rows)), total(plan.weigh(rows.where("k % 7 = 0")))
    assert some == {k: w for k, w in every.items() if k[1] % 7 == 0}

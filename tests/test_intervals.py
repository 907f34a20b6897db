from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from bootframe.functions.normal import norm_ppf
from bootframe.functions.quantiles import quantile_agg
from bootframe.operators.intervals import basic_ci, percentile_ci


def test_norm_ppf_matches_stdlib(spark):
    ps = [1e-12, 1e-5, 0.001, 0.025, 0.3, 0.5, 0.7, 0.975, 0.9999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(norm_ppf(F.col("p")).alias("z")).collect()
    for p, row in zip(ps, got):
        assert row["z"] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-14, abs=1e-14)


@pytest.mark.parametrize(
    "R,alpha,k,weight",
    [(200, 0.975, 195, 0.973041), (200, 0.025, 5, 0.026959), (1000, 0.975, 975, 0.974595), (1000, 0.025, 25, 0.025405)],
)
def test_basic_interval_weights(spark, R, alpha, k, weight):
    # replicate values t_(j) = j (1-based) so the quantile equals k + weight
    reps = spark.range(1, R + 1).select(F.lit("s").alias("scale"), F.col("id").cast("double").alias("t"))
    t0 = spark.createDataFrame([("s", 0.0)], "scale string, d double")
    row = basic_ci(reps, t0, ["scale"], conf=0.95).first()
    q = -row["ci_ll"] if alpha > 0.5 else -row["ci_ul"]
    assert q == pytest.approx(k + weight, abs=5e-6)


def test_basic_interval_drops_non_finite_and_extremes(spark):
    vals = [1.0, 2.0, 3.0, float("nan"), None, float("inf")]
    reps = spark.createDataFrame([("s", v) for v in vals], "scale string, t double")
    t0 = spark.createDataFrame([("s", 2.0)], "scale string, d double")
    row = basic_ci(reps, t0, ["scale"]).first()
    # R = 3: rk = 3.9 → k = 3 = R → t_(3); rk = 0.1 → k = 0 → t_(1)
    assert row["ci_ll"] == pytest.approx(4.0 - 3.0)
    assert row["ci_ul"] == pytest.approx(4.0 - 1.0)


def test_percentile_ci_nearest_rule(spark):
    reps = spark.range(0, 100).select(F.lit("g").alias("k"), F.col("id").cast("double").alias("value"))
    row = percentile_ci(reps, ["k"]).first()
    # m = 100: floor(99·0.025 + .5) = 2, floor(99·0.975 + .5) = 97
    assert (row["median"], row["ci95_ll"], row["ci95_ul"]) == (49.5, 2.0, 97.0)


def test_quantile_rules_differ_as_documented(spark):
    df = spark.range(0, 41).select(F.col("id").cast("double").alias("v"))
    row = df.agg(
        quantile_agg("v", 0.025, "nearest").alias("n"),
        quantile_agg("v", 0.025, "disc").alias("d"),
        quantile_agg("v", 0.025, "linear").alias("l"),
    ).first()
    assert row["n"] == 1.0  # floor(40·0.025 + 0.5) = 1
    assert row["d"] == 1.0  # smallest value with cumulative share ≥ 0.025
    assert row["l"] == pytest.approx(1.0)


def test_percentile_ci_all_null_group(spark):
    reps = spark.createDataFrame([("g", None), ("g", None), ("h", 1.0)], "k string, value double")
    out = {r["k"]: r for r in percentile_ci(reps, ["k"]).collect()}
    assert out["g"]["median"] is None and out["g"]["ci95_ll"] is None and out["g"]["ci95_ul"] is None
    assert out["h"]["ci95_ul"] == 1.0

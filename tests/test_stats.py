import math

import pytest
from pyspark.sql import functions as F

from bootframe.operators.stats import cohens_d, group_stats, grouping_sets_stats, levels, profile


def _dup(spark, rows):
    """Rows (g, x, w) and the same table with each row repeated w times."""
    weighted = spark.createDataFrame(rows, "g string, x double, w bigint")
    flat = [(g, x) for g, x, w in rows for _ in range(w)]
    return weighted, spark.createDataFrame(flat, "g string, x double")


def test_weighted_stats_equal_duplicated_rows(spark):
    rows = [("a", 1.0, 2), ("a", 5.0, 1), ("a", None, 3), ("a", 2.5, 4), ("b", 3.0, 1), ("b", 7.0, 2)]
    weighted, flat = _dup(spark, rows)
    w = {(r["g"], r["stat"]): r["value"] for r in group_stats(weighted, ["g"], ["x"], weight="w").collect()}
    f = {(r["g"], r["stat"]): r["value"] for r in group_stats(flat, ["g"], ["x"]).collect()}
    assert w.keys() == f.keys()
    for k in w:
        assert math.isclose(w[k], f[k], rel_tol=1e-12)


def test_all_null_group_gives_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, x double")
    out = {(r["g"], r["stat"]): r["value"] for r in group_stats(df, ["g"], ["x"]).collect()}
    assert out[("a", "mean")] is None and out[("a", "median")] is None
    assert out[("b", "median")] == 1.0


def test_grouping_sets_distinguish_null_key_from_rollup(spark):
    df = spark.createDataFrame([("a", "x", 1.0), (None, "x", 2.0), ("a", "y", 4.0)], "g string, h string, v double")
    out = grouping_sets_stats(df, [["g"], ["h"], []], ["v"], stats=["mean"]).collect()
    by = {(r["set"], r["g"], r["h"]): r["value"] for r in out}
    assert by[("g", None, None)] == 2.0  # the NULL key group of set g
    assert by[("g", "a", None)] == 2.5
    assert by[("h", None, "x")] == 1.5
    assert by[("", None, None)] == pytest.approx(7 / 3)


def test_levels_sorted_and_bounded(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "g string")
    assert levels(df, "g") == ["a", "b", "c"]
    assert levels(df, "g", limit=2) == ["a", "b"]


def test_profile(spark, survey):
    row = profile(survey).first()
    assert (row["n_rows"], row["n_cols"]) == (400, 7)


def _d(rows, na="propagate", spark=None):
    df = spark.createDataFrame(rows, "g string, x double")
    return cohens_d(df, ["x"], "g", na=na).first()


def test_cohens_d_closed_form(spark):
    a = [1.0, 2.0, 3.0, 4.0]
    b = [2.0, 4.0, 6.0]
    row = _d([("f", v) for v in a] + [("m", v) for v in b], spark=spark)
    ma, mb = sum(a) / 4, sum(b) / 3
    va = sum((v - ma) ** 2 for v in a) / 3
    vb = sum((v - mb) ** 2 for v in b) / 2
    pooled = math.sqrt((3 * va + 2 * vb) / 5)
    assert row["d"] == pytest.approx((ma - mb) / pooled, rel=1e-12)
    assert row["df"] == 5


def test_cohens_d_third_level_ignored_and_sign(spark):
    base = [("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 7.0)]
    d2 = _d(base, spark=spark)["d"]
    d3 = _d(base + [("c", 100.0)], spark=spark)["d"]
    assert d2 == pytest.approx(d3)
    assert d2 < 0


def test_cohens_d_edges(spark):
    assert _d([("a", 1.0), ("a", 2.0)], spark=spark)["d"] is None  # one level
    assert _d([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], spark=spark)["d"] is None  # constant: sd 0
    assert _d([("a", 1.0), ("b", 2.0), ("b", 3.0)], spark=spark)["d"] is None  # level of one row
    with_null = [("a", 1.0), ("a", None), ("a", 3.0), ("b", 2.0), ("b", 5.0)]
    assert _d(with_null, spark=spark)["d"] is None
    omit = _d(with_null, na="omit", spark=spark)
    clean = _d([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 5.0)], spark=spark)
    assert omit["d"] == pytest.approx(clean["d"]) and omit["df"] == clean["df"]
    null_group = [("a", 1.0), ("a", 3.0), (None, 9.0), ("b", 2.0), ("b", 5.0)]
    assert _d(null_group, spark=spark)["d"] is None
    assert _d(null_group, na="omit", spark=spark)["d"] == pytest.approx(clean["d"])

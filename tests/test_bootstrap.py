import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bootframe.functions.draws import poisson1_thresholds
from bootframe.plans.bootstrap import boot_cohens_d, boot_custom, boot_custom_pandas, boot_stats, boot_stats_sets
from tests.brute import md5_uniform, median, nearest, replicate_frames

SCALES = ["IPIP50_agree", "IPIP50_open"]


def _brute_boot_stats(pdf, by, n_iter, seed=42):
    reps: dict = {}
    for _, frame in replicate_frames(pdf, "RID", n_iter, seed):
        grouped = frame.groupby(by, dropna=False) if by else [((), frame)]
        for key, g in grouped:
            key = key if isinstance(key, tuple) else (key,)
            key = tuple(None if (isinstance(k, float) and math.isnan(k)) else k for k in key)
            for s in SCALES:
                vals = g[s].dropna()
                reps.setdefault((*key, s, "mean"), []).append(vals.mean() if len(vals) else None)
                reps.setdefault((*key, s, "median"), []).append(float(vals.median()) if len(vals) else None)
    return {k: (median(v), nearest(v, 0.025), nearest(v, 0.975)) for k, v in reps.items()}


def _rows(df, by):
    return {
        (*[r[c] for c in by], r["scale"], r["stat"]): (r["median"], r["ci95_ll"], r["ci95_ul"]) for r in df.collect()
    }


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            if x is None or y is None:
                assert x is None and y is None, k
            else:
                assert x == pytest.approx(y, rel=1e-9, abs=1e-12), k


def test_boot_stats_matches_brute_force(spark, survey):
    pdf = survey.toPandas()
    got = _rows(boot_stats(survey, "gender", "RID", SCALES, n_iter=15, hash="md5"), ["gender"])
    _close(got, _brute_boot_stats(pdf, ["gender"], 15))


def test_boot_stats_two_keys_and_rare_group(spark, survey):
    pdf = survey.toPandas()
    got = _rows(boot_stats(survey, ["gender", "smoke"], "RID", SCALES, n_iter=12, hash="md5"), ["gender", "smoke"])
    want = _brute_boot_stats(pdf, ["gender", "smoke"], 12)
    _close(got, want)


def test_boot_stats_empty_set_is_whole_table(spark, survey):
    pdf = survey.toPandas()
    got = {(r["scale"], r["stat"]): (r["median"], r["ci95_ll"], r["ci95_ul"])
           for r in boot_stats(survey, [], "RID", SCALES, n_iter=10, hash="md5").collect()}
    _close(got, _brute_boot_stats(pdf, [], 10))


def test_regex_scales_default(spark, survey):
    out = boot_stats(survey, "smoke", "RID", None, n_iter=3)
    assert {r["scale"] for r in out.collect()} == {"IPIP50_agree", "IPIP50_open", "IPIP100_calm"}


def test_shared_sets_equal_single_runs(spark, survey):
    sets = [["gender"], ["smoke"], ["gender", "smoke"]]
    both = boot_stats_sets(survey, sets, "RID", SCALES, n_iter=8, hash="md5")
    for s in sets:
        single = _rows(boot_stats(survey, s, "RID", SCALES, n_iter=8, hash="md5"), s)
        part = _rows(both.where(F.col("set") == ",".join(s)), s)
        _close(part, single)


def test_independent_sets_use_own_seed(spark, survey):
    sets = [["gender"], ["smoke"]]
    ind = boot_stats_sets(survey, sets, "RID", SCALES, n_iter=6, hash="md5", shared=False)
    single = _rows(boot_stats(survey, ["smoke"], "RID", SCALES, n_iter=6, seed=43, hash="md5"), ["smoke"])
    _close(_rows(ind.where(F.col("set") == "smoke"), ["smoke"]), single)


def test_n_iter_edges(spark, survey):
    one = boot_stats(survey, "smoke", "RID", SCALES, n_iter=1).collect()
    assert all(r["ci95_ll"] == r["ci95_ul"] == r["median"] for r in one if r["median"] is not None)
    with pytest.raises(ValueError):
        boot_stats(survey, "smoke", "RID", SCALES, n_iter=0)


def test_poisson_matches_brute_force(spark, survey):
    pdf = survey.toPandas()
    th = poisson1_thresholds()
    reps: dict = {}
    for r in range(6):
        w = np.array([next((k for k, c in enumerate(th) if md5_uniform(42, r, key) < c), len(th)) for key in pdf["RID"]])
        frame = pdf.loc[np.repeat(np.arange(len(pdf)), w)]
        for g, grp in frame.groupby("smoke"):
            v = grp["IPIP50_agree"].dropna()
            reps.setdefault((g, "IPIP50_agree", "mean"), []).append(v.mean() if len(v) else None)
            reps.setdefault((g, "IPIP50_agree", "median"), []).append(float(v.median()) if len(v) else None)
    want = {k: (median(v), nearest(v, 0.025), nearest(v, 0.975)) for k, v in reps.items()}
    got = _rows(boot_stats(survey, "smoke", "RID", ["IPIP50_agree"], n_iter=6, method="poisson", hash="md5"), ["smoke"])
    _close(got, want)


def _r_cohen(x, g, levels):
    a = x[g == levels[0]]
    b = x[g == levels[1]]
    if len(a) < 2 or len(b) < 2:
        return float("nan")
    pooled = math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
    return (a.mean() - b.mean()) / pooled if pooled > 0 else float("nan")


def _basic(t0, t, conf=0.95):
    t = np.sort([v for v in t if np.isfinite(v)])
    R = len(t)
    nd = NormalDist()

    def q(alpha):
        rk = (R + 1) * alpha
        k = int(rk)
        if rk == k:
            return t[k - 1]
        if k == 0:
            return t[0]
        if k == R:
            return t[R - 1]
        w = (nd.inv_cdf(alpha) - nd.inv_cdf(k / (R + 1))) / (nd.inv_cdf((k + 1) / (R + 1)) - nd.inv_cdf(k / (R + 1)))
        return t[k - 1] + w * (t[k] - t[k - 1])

    return 2 * t0 - q((1 + conf) / 2), 2 * t0 - q((1 - conf) / 2)


def test_boot_cohens_d_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 120
    pdf = pd.DataFrame(
        {
            "row_id": np.arange(n),
            "gender": np.where(np.arange(n) % 3 == 0, "m", np.where(np.arange(n) % 3 == 1, "f", "x")),
            "agree": np.round(rng.normal(3, 1, n), 2),
            "open": np.round(rng.normal(3.3, 0.7, n), 2),
        }
    )
    df = spark.createDataFrame(pdf)
    out = {r["scale"]: r for r in boot_cohens_d(df, ["agree", "open"], "gender", "row_id", n_iter=40, hash="md5").collect()}
    lv = ["f", "m"]
    for s in ["agree", "open"]:
        t0 = _r_cohen(pdf[s].to_numpy(), pdf["gender"].to_numpy(), lv)
        ts = [_r_cohen(f[s].to_numpy(), f["gender"].to_numpy(), lv) for _, f in replicate_frames(pdf, "row_id", 40)]
        ll, ul = _basic(t0, ts)
        assert out[s]["d"] == pytest.approx(t0, rel=1e-12)
        assert out[s]["ci_ll"] == pytest.approx(ll, rel=1e-9)
        assert out[s]["ci_ul"] == pytest.approx(ul, rel=1e-9)
        assert out[s]["ci_level"] == 0.95


def test_boot_custom_expression_and_pandas_agree(spark, survey):
    def rng_stat(w):
        return F.max("IPIP50_agree") - F.min("IPIP50_agree")

    expr = boot_custom(survey, rng_stat, "RID", columns=["IPIP50_agree"], n_iter=10, hash="md5").first()

    def partial(pdf):
        return pd.DataFrame({"mn": [pdf["IPIP50_agree"].min()], "mx": [pdf["IPIP50_agree"].max()]})

    def combine(states):
        return float(states["mx"].max() - states["mn"].min())

    pand = boot_custom_pandas(survey, partial, combine, "mn double, mx double", "RID", ["IPIP50_agree"],
                              n_iter=10, hash="md5", rows_per_chunk=100).first()
    assert (expr["median"], expr["ci95_ll"], expr["ci95_ul"]) == pytest.approx(
        (pand["median"], pand["ci95_ll"], pand["ci95_ul"])
    )


def test_approximate_median_close_to_exact(spark, survey):
    exact = {(r["smoke"], r["stat"]): r for r in boot_stats(survey, "smoke", "RID", ["IPIP50_open"], n_iter=30).collect()}
    approx = {(r["smoke"], r["stat"]): r for r in boot_stats(survey, "smoke", "RID", ["IPIP50_open"], n_iter=30,
                                                              median_accuracy=100000).collect()}
    assert exact.keys() == approx.keys()
    for k, row in exact.items():
        if k[1] == "mean":  # means are untouched by the switch
            assert approx[k]["median"] == pytest.approx(row["median"], rel=1e-12)
        elif row["median"] is not None:
            # the sketch returns a data value; scores have one decimal
            assert approx[k]["median"] == pytest.approx(row["median"], abs=0.051)


def test_grouping_names_of_result_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, scale string, x double")
    with pytest.raises(ValueError):
        boot_stats(df, ["scale"], "k", ["x"], n_iter=2)


def test_boot_cohens_d_omit_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    n = 90
    x = np.round(rng.normal(3, 1, n), 2)
    g = np.where(np.arange(n) % 2 == 0, "f", "m").astype(object)
    x = x.astype(object)
    x[[3, 17, 40]] = None  # missing responses
    g[[5, 60]] = None  # missing groups
    pdf = pd.DataFrame({"row_id": np.arange(n), "gender": g, "agree": x})
    df = spark.createDataFrame(pdf, "row_id long, gender string, agree double")
    out = boot_cohens_d(df, ["agree"], "gender", "row_id", n_iter=30, hash="md5", na="omit").first()

    def d_omit(frame):
        f = frame.dropna(subset=["agree", "gender"])
        return _r_cohen(f["agree"].astype(float).to_numpy(), f["gender"].to_numpy(), ["f", "m"])

    t0 = d_omit(pdf)
    ts = [d_omit(f) for _, f in replicate_frames(pdf, "row_id", 30)]
    ll, ul = _basic(t0, ts)
    assert out["d"] == pytest.approx(t0, rel=1e-12)
    assert out["ci_ll"] == pytest.approx(ll, rel=1e-9)
    assert out["ci_ul"] == pytest.approx(ul, rel=1e-9)
    propagate = boot_cohens_d(df, ["agree"], "gender", "row_id", n_iter=30, hash="md5").first()
    assert propagate["d"] is None


def test_boot_custom_forms_agree_per_group(spark, survey):
    def spread(w):
        return F.max("IPIP50_open") - F.min("IPIP50_open")

    expr = {r["smoke"]: (r["median"], r["ci95_ll"], r["ci95_ul"])
            for r in boot_custom(survey, spread, "RID", by=["smoke"], columns=["IPIP50_open"], n_iter=12).collect()}

    def partial(pdf):
        return pd.DataFrame({"mn": [pdf["IPIP50_open"].min()], "mx": [pdf["IPIP50_open"].max()]})

    def combine(states):
        return float(states["mx"].max() - states["mn"].min())

    pand = {r["smoke"]: (r["median"], r["ci95_ll"], r["ci95_ul"])
            for r in boot_custom_pandas(survey, partial, combine, "mn double, mx double", "RID", ["IPIP50_open"],
                                        by=["smoke"], n_iter=12, rows_per_chunk=50).collect()}
    assert expr.keys() == pand.keys()
    for k in expr:
        if expr[k][0] is None:
            continue
        assert expr[k] == pytest.approx(pand[k])


@pytest.mark.parametrize("method", ["exact", "poisson", "multinomial"])
def test_pandas_statistic_is_folded_where_its_rows_are(spark, survey, method):
    """Weighted sums per group and replicate equal Spark's, whatever the chunks; only states are shuffled."""
    def partial(pdf):
        assert len(pdf) <= 17 and pdf["r"].nunique() == 1
        return pd.DataFrame({"s": [(pdf["IPIP50_open"] * pdf["w"]).sum()], "n": [float((pdf["w"] * pdf["IPIP50_open"].notna()).sum())]})

    def combine(states):
        return float(states["s"].sum() / states["n"].sum())

    args = dict(by=["smoke"], n_iter=9, method=method, hash="md5")
    got = boot_custom_pandas(survey, partial, combine, "s double, n double", "RID", ["IPIP50_open"], rows_per_chunk=17, **args)
    plan = got._jdf.queryExecution().executedPlan().toString()
    weighed = plan[plan.index("MapInPandas"):]
    assert "FlatMapGroupsInPandas" in plan[: plan.index("MapInPandas")] and "IPIP50_open" not in plan[: plan.index("MapInPandas")]
    assert "Sort" in weighed and "hashpartitioning(smoke" not in weighed
    want = boot_custom(survey, lambda w: F.sum(F.col("IPIP50_open") * w) / F.sum(F.when(F.col("IPIP50_open").isNotNull(), w)), "RID",
                       columns=["IPIP50_open"], **args)
    want = {r["smoke"]: r["median"] for r in want.collect()}
    got = {r["smoke"]: r["median"] for r in got.collect()}
    assert got.keys() == want.keys() and len(got) > 1
    assert all(got[k] == pytest.approx(want[k]) for k in want if want[k] is not None)


def test_independent_sets_poisson_use_own_seed(spark, survey):
    ind = boot_stats_sets(survey, [["gender"], ["smoke"]], "RID", SCALES, n_iter=6, method="poisson", shared=False)
    single = _rows(boot_stats(survey, ["smoke"], "RID", SCALES, n_iter=6, seed=43, method="poisson"), ["smoke"])
    _close(_rows(ind.where(F.col("set") == "smoke"), ["smoke"]), single)


@pytest.mark.parametrize("name", ["w", "r", "i", "value", "d", "t", "_x", "stat", "set", "median"])
@pytest.mark.parametrize("method", ["exact", "poisson"])
def test_measures_may_have_names_that_plans_use(spark, name, method):
    plain = spark.range(0, 100).select(F.col("id").alias("k"), (F.col("id") * 10).alias("m"))
    want = boot_stats(plain, [], "k", ["m"], n_iter=20, method=method).collect()
    got = boot_stats(plain.withColumnRenamed("m", name), [], "k", [name], n_iter=20, method=method).collect()
    assert {r["scale"] for r in got} == {name}
    values = lambda rows: sorted((r["stat"], r["median"], r["ci95_ll"], r["ci95_ul"]) for r in rows)
    assert values(got) == values(want) and 400 < values(got)[0][1] < 600


def test_groups_and_keys_may_have_names_that_plans_use(spark):
    plain = spark.range(0, 200).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("m"))
    renamed = plain.toDF("i", "w", "r")
    want = boot_stats_sets(plain, [["g"], []], "k", ["m"], n_iter=10).collect()
    got = boot_stats_sets(renamed, [["w"], []], "i", ["r"], n_iter=10).collect()
    assert sorted(str((r["set"].replace("w", "g"), r["w"], r["stat"], r["median"])) for r in got) == sorted(
        str((r["set"], r["g"], r["stat"], r["median"])) for r in want
    )
    d = boot_cohens_d(renamed, ["r"], "w", "i", n_iter=10).first()
    assert d["scale"] == "r" and d["d"] == boot_cohens_d(plain, ["m"], "g", "k", n_iter=10).first()["d"]
    with pytest.raises(ValueError):
        boot_stats(plain.withColumnRenamed("g", "stat"), ["stat"], "k", ["m"], n_iter=2)


@pytest.mark.parametrize("shared", [True, False])
def test_sets_with_the_same_members_all_come_out(spark, shared):
    df = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), F.col("id").alias("m"))
    out = boot_stats_sets(df, [["a", "b"], ["b", "a"], ["a"], ["a"]], "k", ["m"], n_iter=10, shared=shared, stats=["mean"])
    rows = {}
    for r in out.collect():
        rows.setdefault(r["set"], []).append((r["a"], r["b"], r["median"]))
    assert {s: len(v) for s, v in rows.items()} == {"a,b": 6, "b,a": 6, "a": 2}
    assert sorted(rows["a,b"]) == sorted(rows["b,a"])

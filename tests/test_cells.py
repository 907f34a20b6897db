import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bootframe.operators.cells import poisson_cell_weights, set_cells
from bootframe.plans.bootstrap import boot_stats, boot_stats_sets
from tests.brute import median, nearest


def test_cells_count_values_per_set_group(spark, survey):
    cells = set_cells(survey, [["smoke"], []], ["IPIP100_calm"])
    total = {r["set"]: r["n"] for r in cells.groupBy("set").agg(F.sum("c").alias("n")).collect()}
    assert total == {"smoke": 400, "": 400}
    # IPIP100_calm takes 5 values: whole-table set has 5 cells
    assert cells.where(F.col("set") == "").count() == 5


def weights_by_force(cell, r, seed):
    """Poisson weight of one cell, its pieces drawn from md5 uniforms by the distribution function."""
    text = [str(v) if v is not None else "~" for v in cell[:-1]]
    tags = [("z", cell[-1])] if cell[-1] >= 64 else [(f"b{b}", 1 << b) for b in range(6) if cell[-1] >> b & 1]
    total = 0
    for tag, size in tags:
        u = int(hashlib.md5("|".join([str(seed), str(r), *text, tag]).encode()).hexdigest()[:13], 16) / 2**52
        if tag == "z":
            z, m = NormalDist().inv_cdf(max(u, 2.0**-54)), float(size)
            q = m + math.sqrt(m) * z + 1 / 3 + z * z / 6 + (-z / 36 - z**3 / 72) / math.sqrt(m) + (-8 / 405 + 7 * z * z / 810 + z**4 / 270) / m
            total += max(math.floor(q), 0)
        else:
            k, term = 0, math.exp(-size)
            cum = term
            while cum <= u:
                k += 1
                term *= size / k
                cum += term
            total += k
    return total


def test_cell_weights_match_brute_force_and_ignore_partitioning(spark, survey):
    cells = set_cells(survey, [["smoke"]], ["IPIP100_calm"])
    a = poisson_cell_weights(cells, 30, 3, "md5").groupBy("set", "smoke", "scale", "value", "r").agg(F.sum("w").alias("w")).collect()
    b = poisson_cell_weights(cells.repartition(5), 30, 3, "md5").groupBy("set", "smoke", "scale", "value", "r").agg(F.sum("w").alias("w")).collect()
    key = lambda rows: sorted((str(r["smoke"]), r["value"], r["r"], r["w"]) for r in rows)
    assert key(a) == key(b)
    want = []
    for c in cells.collect():
        assert c["value"] == float(c["value"])
        for r in range(30):
            w = weights_by_force((c["set"], c["smoke"], c["scale"], c["value"], c["c"]), r, 3)
            if w:
                want.append((str(c["smoke"]), c["value"], r, w))
    assert key(a) == sorted(want)


def test_large_counts_have_the_moments_of_a_poisson(spark):
    cells = spark.createDataFrame([("s", "x", 1.0, 50), ("s", "x", 2.0, 64), ("s", "x", 3.0, 10**6)], "set string, scale string, value double, c long")
    got = poisson_cell_weights(cells, 20_000).groupBy("value", "r").agg(F.sum("w").alias("w")).groupBy("value").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).collect()
    for row, c in zip(sorted(got), (50, 64, 10**6)):
        mean = row["s"] / 20_000
        assert mean == pytest.approx(c, abs=4 * (c / 20_000) ** 0.5)
        assert row["q"] / 20_000 - mean**2 == pytest.approx(c, rel=0.05)


def test_collapsed_bootstrap_matches_brute_force_on_cells(spark, survey):
    got = {(r["smoke"], r["stat"]): (r["median"], r["ci95_ll"], r["ci95_ul"])
           for r in boot_stats(survey, "smoke", "RID", ["IPIP100_calm"], n_iter=25, method="poisson",
                               collapse=True, seed=9, hash="md5").collect()}
    cells = set_cells(survey, [["smoke"]], ["IPIP100_calm"], "_set").collect()
    reps: dict = {}
    for r in range(25):
        for g in {c["smoke"] for c in cells}:
            flat = [c["value"] for c in cells if c["smoke"] == g for _ in range(weights_by_force((c["_set"], g, c["scale"], c["value"], c["c"]), r, 9))]
            if flat:
                reps.setdefault((g, "mean"), []).append(float(np.mean(flat)))
                reps.setdefault((g, "median"), []).append(float(np.median(flat)))
    want = {k: (median(v), nearest(v, 0.025), nearest(v, 0.975)) for k, v in reps.items()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_collapsed_close_to_row_poisson(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.arange(4000), "g": rng.choice(["a", "b"], 4000), "x": rng.integers(1, 6, 4000) * 1.0})
    df = spark.createDataFrame(pdf)
    rows = {(r["g"], r["stat"]): r for r in boot_stats(df, "g", "k", ["x"], n_iter=300, method="poisson").collect()}
    cells = {(r["g"], r["stat"]): r for r in boot_stats(df, "g", "k", ["x"], n_iter=300, method="poisson",
                                                         collapse=True).collect()}
    for k in rows:
        assert cells[k]["median"] == pytest.approx(rows[k]["median"], abs=0.02)
        wr = rows[k]["ci95_ul"] - rows[k]["ci95_ll"]
        wc = cells[k]["ci95_ul"] - cells[k]["ci95_ll"]
        if k[1] == "mean":
            assert wc == pytest.approx(wr, rel=0.25)


def test_exact_cells_draw_n_per_set_scale_and_replicate(spark, survey):
    from bootframe.operators.cells import multinomial_cell_weights

    cells = set_cells(survey, [["smoke"], ["gender", "smoke"]], ["IPIP100_calm", "IPIP50_agree"])
    w = multinomial_cell_weights(cells, 40, seed=2)
    totals = w.groupBy("set", "scale", "r").agg(F.sum("w").alias("t")).collect()
    assert len(totals) == 2 * 2 * 40
    assert {r["t"] for r in totals} == {400}
    again = multinomial_cell_weights(cells.repartition(3), 40, seed=2)
    key = lambda rows: sorted((r["set"], r["scale"], str(r["gender"]), str(r["smoke"]), str(r["value"]), r["r"], r["w"])
                              for r in rows)
    assert key(w.collect()) == key(again.collect())


def test_exact_cells_close_to_exact_rows(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": np.arange(3000), "g": rng.choice(["a", "b", "c"], 3000), "x": rng.integers(1, 8, 3000) * 1.0})
    df = spark.createDataFrame(pdf)
    rows = {(r["g"], r["stat"]): r for r in boot_stats(df, "g", "k", ["x"], n_iter=300).collect()}
    cells = {(r["g"], r["stat"]): r for r in boot_stats(df, "g", "k", ["x"], n_iter=300, collapse=True).collect()}
    for k in rows:
        assert cells[k]["median"] == pytest.approx(rows[k]["median"], abs=0.05)
        if k[1] == "mean":
            wr = rows[k]["ci95_ul"] - rows[k]["ci95_ll"]
            wc = cells[k]["ci95_ul"] - cells[k]["ci95_ll"]
            assert wc == pytest.approx(wr, rel=0.25)


def test_exact_cells_in_many_ranges_are_multinomial(spark):
    from bootframe.operators.cells import multinomial_cell_weights

    df = spark.range(0, 900).select(F.col("id").alias("k"), (F.col("id") % 300 * 1.37 + F.when(F.col("id") < 450, 0).otherwise(300)).alias("x"))
    cells = set_cells(df, [[]], ["x"])
    got = multinomial_cell_weights(cells, 400, range_cells=16).select("value", "r", "w").toPandas()
    again = multinomial_cell_weights(cells.repartition(5), 400, range_cells=16).select("value", "r", "w").toPandas()
    order = lambda pdf: pdf.sort_values(["r", "value"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(again))
    assert (got.groupby("r")["w"].sum() == 900).all() and got["r"].nunique() == 400
    c = {r["value"]: r["c"] for r in cells.collect()}
    assert len(c) > 400
    wide = got.pivot(index="r", columns="value", values="w").reindex(columns=sorted(c)).fillna(0)
    n = np.array([c[v] for v in wide.columns])
    # mean c, variance c (1 - c / n), and the negative covariance of a fixed sum, between cells of any ranges
    assert abs(wide.mean() - n).max() < 6 * np.sqrt(n.max() / 400)
    assert wide.var().mean() == pytest.approx((n * (1 - n / 900)).mean(), rel=0.03)
    half = wide.loc[:, wide.columns[::2]].sum(axis=1)
    p = n[::2].sum() / 900
    assert half.var() == pytest.approx(900 * p * (1 - p), rel=0.3)


def test_set_cells_roll_up_from_the_finest_counts(spark):
    rows = [(a, b, x, y) for a in ("p", "q", None) for b in (1, 2) for x, y in ((1, None), (2, 0.5), (2, 0.5))]
    df = spark.createDataFrame(rows, "a string, b int, x int, y double")
    got = {tuple(r) for r in set_cells(df, [["a"], ["b", "a"], []], ["x", "y"]).collect()}
    want = {}
    for name, keys in (("a", "a"), ("b,a", "ba"), ("", "")):
        for a, b, x, y in rows:
            for scale, v in (("x", x), ("y", y)):
                k = (name, a if "a" in keys else None, b if "b" in keys else None, scale, v)
                want[k] = want.get(k, 0) + 1
    assert got == {(*k, c) for k, c in want.items()}


def test_collapsed_cohens_d_close_to_row_poisson(spark):
    from bootframe.plans.bootstrap import boot_cohens_d

    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({
        "row_id": np.arange(n),
        "gender": rng.choice(["f", "m", "x"], n, p=[0.45, 0.45, 0.1]),
        "agree": rng.integers(1, 6, n) * 1.0,
        "calm": rng.integers(1, 8, n) * 0.5,
    })
    pdf.loc[pdf["gender"] == "m", "agree"] += 0.3
    df = spark.createDataFrame(pdf)
    rows = {r["scale"]: r for r in boot_cohens_d(df, ["agree", "calm"], "gender", "row_id", n_iter=300,
                                                  method="poisson").collect()}
    cells = {r["scale"]: r for r in boot_cohens_d(df, ["agree", "calm"], "gender", "row_id", n_iter=300,
                                                   method="poisson", collapse=True).collect()}
    for s in ("agree", "calm"):
        assert cells[s]["d"] == rows[s]["d"]  # t0 is the same statistic
        wr = rows[s]["ci_ul"] - rows[s]["ci_ll"]
        wc = cells[s]["ci_ul"] - cells[s]["ci_ll"]
        assert wc == pytest.approx(wr, rel=0.2)
        assert cells[s]["ci_ll"] < cells[s]["d"] < cells[s]["ci_ul"]


def test_collapsed_cohens_d_propagates_missing(spark):
    from bootframe.plans.bootstrap import boot_cohens_d

    rows = [(i, "a" if i % 2 else "b", float(i % 5) if i != 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, g string, x double")
    out = boot_cohens_d(df, ["x"], "g", "row_id", n_iter=50, method="poisson", collapse=True).first()
    assert out["d"] is None
    omit = boot_cohens_d(df, ["x"], "g", "row_id", n_iter=50, method="poisson", collapse=True, na="omit").first()
    assert omit["d"] is not None and omit["ci_ll"] <= omit["ci_ul"]


def test_exact_collapsed_cohens_d_close_to_rows(spark):
    from bootframe.plans.bootstrap import boot_cohens_d

    rng = np.random.default_rng(5)
    n = 2000
    pdf = pd.DataFrame({"row_id": np.arange(n), "gender": rng.choice(["f", "m", "x"], n),
                        "agree": rng.integers(1, 6, n) * 1.0})
    df = spark.createDataFrame(pdf)
    rows = boot_cohens_d(df, ["agree"], "gender", "row_id", n_iter=300).first()
    cells = boot_cohens_d(df, ["agree"], "gender", "row_id", n_iter=300, collapse=True).first()
    assert cells["d"] == rows["d"]
    assert (cells["ci_ul"] - cells["ci_ll"]) == pytest.approx(rows["ci_ul"] - rows["ci_ll"], rel=0.2)

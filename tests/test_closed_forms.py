"""Closed forms and symmetry properties from the test strategy."""

import math

import numpy as np
import pandas as pd
import pytest

from bootframe.plans.bootstrap import boot_cohens_d, boot_stats


@pytest.fixture(scope="module")
def normal_sample(spark):
    rng = np.random.default_rng(21)
    n = 2000
    pdf = pd.DataFrame({"k": np.arange(n), "g": rng.choice(["a", "b"], n), "x": rng.normal(10, 3, n)})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("method", ["exact", "poisson", "multinomial"])
def test_mean_interval_width_matches_standard_error(normal_sample, method):
    df, pdf = normal_sample
    row = [r for r in boot_stats(df, [], "k", ["x"], n_iter=400, method=method).collect() if r["stat"] == "mean"][0]
    se = pdf["x"].std(ddof=1) / math.sqrt(len(pdf))
    assert row["ci95_ul"] - row["ci95_ll"] == pytest.approx(2 * 1.96 * se, rel=0.15)
    assert row["median"] == pytest.approx(pdf["x"].mean(), abs=0.5 * se)


def test_interval_brackets_the_median(normal_sample):
    df, _ = normal_sample
    for r in boot_stats(df, "g", "k", ["x"], n_iter=100).collect():
        assert r["ci95_ll"] <= r["median"] <= r["ci95_ul"]


def test_cohens_d_flips_sign_with_level_order(normal_sample):
    df, _ = normal_sample
    ab = boot_cohens_d(df, ["x"], "g", "k", n_iter=100, levels=["a", "b"]).first()
    ba = boot_cohens_d(df, ["x"], "g", "k", n_iter=100, levels=["b", "a"]).first()
    assert ba["d"] == pytest.approx(-ab["d"], rel=1e-12)
    # same replicates, mirrored statistic: the basic interval mirrors too
    assert ba["ci_ll"] == pytest.approx(-ab["ci_ul"], rel=1e-9, abs=1e-12)
    assert ba["ci_ul"] == pytest.approx(-ab["ci_ll"], rel=1e-9, abs=1e-12)

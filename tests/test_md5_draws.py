"""Draws of the md5 family that are shuffled are hashed by the array, not as a column of strings."""

import hashlib

import pytest

from bootframe.functions.draws import md5_bits
from bootframe.operators.resample import exact_draws, resample


@pytest.mark.parametrize("seed,r,first,last", [(42, 0, 0, 10_012), (42, 199, 9_990, 10_020), (-7, 12, 99_999_995, 100_000_005), (10**15, 3, 5, 12), (0, 1_234_567, 54_000_000, 54_000_003), (1, 2, 0, 0)])
def test_md5_of_many_draws_equals_the_library(seed, r, first, last):
    want = [int(hashlib.md5(f"{seed}|{r}|{s}".encode()).hexdigest()[:15], 16) for s in range(first, last)]
    assert md5_bits(seed, r, first, last).tolist() == want


def test_md5_of_more_than_a_block_is_refused():
    with pytest.raises(ValueError):
        md5_bits(42, 10**45, 10**10, 10**10 + 1)


@pytest.mark.parametrize("hash", ["md5", "xxhash64"])
def test_shuffled_draws_equal_those_of_the_column(spark, monkeypatch, hash):
    from bootframe.operators import resample as R

    monkeypatch.setattr(R, "DRAWS_PER_GROUP", 100)
    monkeypatch.setattr(R, "DRAWS_PER_TASK", 130)
    df = spark.range(37).toDF("k")
    with pytest.warns(UserWarning):
        out = resample(df, "k", 11, seed=5, hash=hash, broadcast_limit=0)
    want = {(x["r"], x["i"]): x["count"] for x in exact_draws(spark, 37, 11, 5, hash).groupBy("r", "i").count().collect()}
    assert {(x["r"], x["k"]): x["w"] for x in out.collect()} == want
    assert "md5(" not in out._jdf.queryExecution().executedPlan().toString()

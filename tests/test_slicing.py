import pytest

from bootframe.operators.slicing import pick_slice, slice_sets

SETS = [f"c{i}" for i in range(9)] + [(f"c{i}", f"c{i + 1}") for i in range(3)]


@pytest.mark.parametrize("tasks,chunks", [(1, 1), (4, 4), (5, 3), (7, 2), (8, 3), (9, 3), (10, 4), (11, 6), (13, 1)])
def test_batched_rule_chunk_counts(spark, tasks, chunks):
    got = {r["slice"] for r in slice_sets(spark, SETS, tasks, "batched").collect()}
    assert len(got) == chunks


@pytest.mark.parametrize("tasks", [1, 3, 5, 7, 12, 13])
def test_ntile_covers_every_set_once(spark, tasks):
    rows = slice_sets(spark, SETS, tasks, "ntile").collect()
    assert sorted(r["idx"] for r in rows) == list(range(12))
    sizes = {}
    for r in rows:
        sizes[r["slice"]] = sizes.get(r["slice"], 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1
    picked = [s for t in range(1, tasks + 1) for s in pick_slice(spark, SETS, tasks, t)]
    assert len(picked) == 12

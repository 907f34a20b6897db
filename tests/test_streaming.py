import os

import pytest

from bootframe.streaming.merge import merge_stream


def test_merge_stream_appends_each_file_once(spark, tmp_path):
    src = tmp_path / "output"
    os.makedirs(src)
    (src / "agree_by_gender.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\nagree,0.1,0.95,-0.2,0.3\n")
    (src / "open_by_gender.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\nopen,0.5,0.95,0.1,0.9\n")
    out = tmp_path / "merged"
    ckpt = tmp_path / "ckpt"
    merge_stream(spark, str(src), str(out), checkpoint=str(ckpt))
    merged = spark.read.option("header", True).csv(str(out))
    assert sorted(r["scale"] for r in merged.collect()) == ["agree", "open"]
    # a later file is picked up by the next run; earlier ones are not read twice
    (src / "calm_by_gender.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\ncalm,0.0,0.95,-0.1,0.1\n")
    merge_stream(spark, str(src), str(out), checkpoint=str(ckpt))
    merged = spark.read.option("header", True).csv(str(out))
    assert sorted(r["scale"] for r in merged.collect()) == ["agree", "calm", "open"]


def test_merge_stream_continuous_picks_up_new_files(spark, tmp_path):
    src = tmp_path / "incoming"
    os.makedirs(src)
    (src / "a_by_gender.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\na,0.1,0.95,-0.2,0.3\n")
    out = tmp_path / "merged"
    query = merge_stream(spark, str(src), str(out), checkpoint=str(tmp_path / "ck"), once=False)
    try:
        query.processAllAvailable()
        (src / "b_by_gender.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\nb,0.2,0.95,-0.1,0.4\n")
        query.processAllAvailable()
    finally:
        query.stop()
    merged = spark.read.option("header", True).csv(str(out))
    assert sorted(r["scale"] for r in merged.collect()) == ["a", "b"]


def test_streams_into_folders_of_one_name_keep_apart(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    (src / "a.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\na,0.1,0.95,-0.2,0.3\n")
    for folder in ("o1", "o2"):
        merge_stream(spark, str(src), str(tmp_path / folder / "merged"))
        assert spark.read.option("header", True).csv(str(tmp_path / folder / "merged")).count() == 1


def test_stream_with_a_lost_checkpoint_or_other_column_order_is_refused(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    (src / "a.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\na,0.1,0.95,-0.2,0.3\n")
    out = str(tmp_path / "merged")
    merge_stream(spark, str(src), out, checkpoint=str(tmp_path / "c1"))
    (src / "b.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\nb,0.1,0.95,-0.2,0.3\n")
    with pytest.raises(ValueError):
        merge_stream(spark, str(src), out, checkpoint=str(tmp_path / "c2"))
    merge_stream(spark, str(src), out, checkpoint=str(tmp_path / "c1"))
    assert spark.read.option("header", True).csv(out).count() == 2
    (src / "c.csv").write_text("scale,ci.ul,ci.ll,ci.level,d\nc,0.8,0.2,0.95,0.4\n")
    with pytest.raises(Exception):  # noqa: B017
        merge_stream(spark, str(src), out, checkpoint=str(tmp_path / "c1"))

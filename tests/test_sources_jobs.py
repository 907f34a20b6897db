import gzip
import os

import pytest
from pyspark.sql import functions as F

from bootframe.plans.jobs import run_boot_job, run_cohens_d_job
from bootframe.sources import sinks
from bootframe.sources.sinks import bind_by_name, merge_results, set_file_name
from bootframe.sources.tables import read_table

CSV = """RID,gender,smoke,age,IPIP50_agree,IPIP100_calm
R1,female,never,30,3.5,NA
R2,male,,41,"",2.0
R3,NA,past,22,4.0,3.0
R4,female,"",35,2.5,1.5
R5,male,never,NA,1.0,4.5
R6,female,past,28,3.0,2.5
"""


@pytest.fixture()
def csv_paths(tmp_path):
    plain = tmp_path / "scores.csv"
    plain.write_text(CSV)
    gz = tmp_path / "scores.csv.gz"
    with gzip.open(gz, "wt") as f:
        f.write(CSV)
    return str(plain), str(gz)


def test_csv_null_tokens_and_gzip(spark, csv_paths):
    plain, gz = csv_paths
    for p in (plain, gz):
        df = read_table(spark, p)
        assert df.count() == 6
        assert df.where(F.col("gender").isNull()).count() == 1
        assert df.where(F.col("smoke").isNull()).count() == 2  # unquoted and quoted empty
        assert df.where(F.col("IPIP50_agree").isNull()).count() == 1
        assert dict(df.dtypes)["IPIP100_calm"] == "double"


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "nope.csv"))


def test_many_files_read_as_one_table(spark, csv_paths):
    plain, gz = csv_paths
    assert read_table(spark, [plain, gz]).count() == 12


def test_set_file_names():
    assert set_file_name(["gender", "smoke"]) == "boot_gender,smoke.csv"
    assert set_file_name([]) == "boot.csv"


def test_boot_job_writes_one_file_per_set(spark, csv_paths, tmp_path):
    plain, _ = csv_paths
    out = tmp_path / "out"
    files = run_boot_job(spark, plain, str(out), categories=["gender", ("gender", "smoke"), ()], n_iter=5)
    assert [os.path.basename(f) for f in files] == ["boot_gender.csv", "boot_gender,smoke.csv", "boot.csv"]
    g = spark.read.option("header", True).csv(str(out / "boot_gender.csv"))
    assert g.columns == ["gender", "scale", "stat", "median", "ci95.ll", "ci95.ul"]
    assert g.select("scale").distinct().count() == 2


def test_boot_job_default_categories_and_slices(spark, csv_paths, tmp_path):
    plain, _ = csv_paths
    files = run_boot_job(spark, plain, str(tmp_path / "a"), n_iter=3)
    assert sorted(os.path.basename(f) for f in files) == ["boot_gender.csv", "boot_smoke.csv"]
    sets = ["gender", "smoke", ("gender", "smoke")]
    got = []
    for task in (1, 2, 3):
        got += run_boot_job(spark, plain, str(tmp_path / "b"), categories=sets, n_iter=3, tasks=3, task=task)
    assert sorted(os.path.basename(f) for f in got) == ["boot_gender,smoke.csv", "boot_gender.csv", "boot_smoke.csv"]


def test_cohens_d_job_and_merge_keep_inputs(spark, tmp_path):
    rows = [(i, "f" if i % 2 else "m", float(i % 7), float((i * 3) % 5)) for i in range(60)]
    src = tmp_path / "bfi"
    spark.createDataFrame(rows, "row_id int, gender string, agree double, openness double").write.parquet(str(src))
    out = tmp_path / "output"
    res = run_cohens_d_job(spark, str(src), str(out), ["agree", "openness"], n_iter=20)
    assert [r["scale"] for r in res.collect()] == ["agree", "openness"]
    assert os.path.isdir(out / "agree_by_gender.csv") and os.path.isdir(out / "openness_by_gender.csv")
    merged = spark.read.option("header", True).csv(str(out / "combined.csv"))
    assert merged.count() == 2 and merged.columns == ["scale", "d", "ci.level", "ci.ll", "ci.ul"]
    with pytest.raises(ValueError):
        merge_results(spark, [str(out / "combined.csv")], str(out / "combined.csv"))


def test_command_line_boot_and_merge(spark, csv_paths, tmp_path):
    from bootframe.__main__ import main

    plain, gz = csv_paths
    out = tmp_path / "cli"
    assert main(["boot", "--input", gz, "--output-dir", str(out), "--n-iter", "4",
                 "--categories", "gender", "gender,smoke"], spark=spark) == 0
    assert sorted(os.listdir(out)) == ["boot_gender,smoke.csv", "boot_gender.csv"]
    merged = tmp_path / "merged.csv"
    with pytest.raises(ValueError):  # the files' columns differ
        main(["merge", "--output", str(merged), str(out / "boot_gender.csv"), str(out / "boot_gender,smoke.csv")], spark=spark)
    assert not merged.exists()
    assert main(["merge", "--output", str(merged), str(out / "boot_gender.csv")], spark=spark) == 0
    rows = lambda p: sorted(map(tuple, spark.read.option("header", True).csv(str(p)).collect()), key=str)
    assert rows(merged) == rows(out / "boot_gender.csv")
    with pytest.raises(ValueError):
        main(["boot", "--input", str(tmp_path / "missing.csv")], spark=spark)


def test_dates_stay_text_unless_asked(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("RID,collected,gender,IPIP_a\nR1,2017-01-05,f,3.5\nR2,2017-02-11,m,NA\n")
    df = read_table(spark, str(p))
    assert dict(df.dtypes) == {"RID": "string", "collected": "string", "gender": "string", "IPIP_a": "double"}
    assert dict(read_table(spark, str(p), parse_dates=True).dtypes)["collected"] == "date"


def test_command_line_cohens_d_collapsed(spark, tmp_path):
    from bootframe.__main__ import main

    rows = [(i, "f" if i % 2 else "m", float(i % 5), float((i * 3) % 7)) for i in range(120)]
    src = tmp_path / "bfi.parquet"
    spark.createDataFrame(rows, "row_id int, gender string, agree double, openness double").write.parquet(str(src))
    out = tmp_path / "output"
    assert main(["cohens-d", "--input", str(src), "--scales", "agree", "openness", "--n-iter", "30",
                 "--collapse", "--output-dir", str(out)], spark=spark) == 0
    assert sorted(os.listdir(out)) == ["agree_by_gender.csv", "combined.csv", "openness_by_gender.csv"]


def test_large_results_are_written_in_parallel_parts(spark, tmp_path, monkeypatch):
    from bootframe.sources import sinks

    df = spark.range(0, 100, 1, 4).selectExpr("id", "id * 2 AS v")
    sinks._write_csv(df, str(tmp_path / "one"))
    monkeypatch.setattr(sinks, "SINGLE_PART_ROWS", 10)
    sinks._write_csv(df, str(tmp_path / "many"))
    parts = lambda d: [f for f in os.listdir(d) if f.startswith("part-")]
    assert len(parts(tmp_path / "one")) == 1
    assert len(parts(tmp_path / "many")) > 1
    assert spark.read.option("header", True).csv(str(tmp_path / "many")).count() == 100


def test_extra_null_tokens_in_numeric_columns(spark, tmp_path):
    p = tmp_path / "tok.csv"
    p.write_text("RID,gender,score,count\nR1,f,3.5,4\nR2,missing,missing,missing\nR3,m,NA,2\nR4,f,1.25,\n")
    df = read_table(spark, str(p), null_values=("NA", "", "missing"))
    assert dict(df.dtypes) == {"RID": "string", "gender": "string", "score": "double", "count": "bigint"}
    rows = {r["RID"]: r for r in df.collect()}
    assert rows["R2"]["gender"] is None and rows["R2"]["score"] is None and rows["R2"]["count"] is None
    assert rows["R3"]["score"] is None and rows["R4"]["count"] is None and rows["R1"]["score"] == 3.5


def test_merge_matches_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("scale,d,ci.level,ci.ll,ci.ul\nx,0.5,0.95,0.1,0.9\n")
    (tmp_path / "b.csv").write_text("scale,ci.ul,ci.ll,ci.level,d\ny,0.8,0.2,0.95,0.4\n")
    merge_results(spark, [str(tmp_path / "?.csv")], str(tmp_path / "out" / "m"))
    got = {r["scale"]: r.asDict() for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "m")).collect()}
    assert got["y"] == {"scale": "y", "d": "0.4", "ci.level": "0.95", "ci.ll": "0.2", "ci.ul": "0.8"}
    both = {r["scale"]: r["d"] for r in read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert both == {"x": 0.5, "y": 0.4}


def test_merge_twice_over_a_pattern_keeps_the_first_result(spark, tmp_path):
    (tmp_path / "a.csv").write_text("scale,d\nx,0.5\n")
    (tmp_path / "b.csv").write_text("scale,d\ny,0.4\n")
    args = spark, [str(tmp_path / "*.csv")], str(tmp_path / "combined.csv")
    assert merge_results(*args).count() == 2
    with pytest.raises(ValueError):
        merge_results(*args)
    assert spark.read.option("header", True).csv(str(tmp_path / "combined.csv")).count() == 2


def test_command_line_with_uris_leaves_no_stray_folder(spark, csv_paths, tmp_path, monkeypatch):
    from bootframe.__main__ import main

    monkeypatch.chdir(tmp_path)
    plain, _ = csv_paths
    before = set(os.listdir(tmp_path))
    assert main(["boot", "--input", f"file://{plain}", "--output-dir", f"file://{tmp_path}/uri", "--n-iter", "3",
                 "--categories", "gender", "--independent", "--ci", "0.9"], spark=spark) == 0
    assert set(os.listdir(tmp_path)) - before == {"uri"} and os.listdir(tmp_path / "uri") == ["boot_gender.csv"]


def test_files_of_different_types_and_orders_bind_to_the_common_type(spark, tmp_path):
    files = {
        "a.csv": "n,x,code,day,flag,none\n1,2,007,2020-01-02,true,\n2,,8,2020-01-03,false,\n",
        "b c.csv": "x,n,day,code,none,flag\n2.5,3,2020-02-01,A9,,true\n",
        "c.csv": "\"code\",n,x,day,flag,none\n5,3000000000,1,2020-02-01 10:00:00,,\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    out = bind_by_name(spark, [str(tmp_path / f) for f in files])
    assert out.columns == ["n", "x", "code", "day", "flag", "none"]
    assert [t for _, t in out.dtypes] == ["bigint", "double", "string", "timestamp", "boolean", "string"]
    rows = {r["n"]: r for r in out.collect()}
    assert {n: r["code"] for n, r in rows.items()} == {1: "007", 2: "8", 3: "A9", 3000000000: "5"}
    assert rows[1]["x"] == 2.0 and rows[2]["x"] is None and rows[3]["x"] == 2.5 and rows[3000000000]["flag"] is None
    merged = merge_results(spark, [str(tmp_path / "*.csv")], str(tmp_path / "out" / "m"))
    assert merged.dtypes == out.dtypes and sorted(map(str, merged.collect())) == sorted(map(str, out.collect()))
    table = read_table(spark, str(tmp_path / "*.csv"))
    assert dict(table.dtypes)["code"] == dict(table.dtypes)["day"] == "string" and dict(table.dtypes)["n"] == "bigint" and table.count() == 4


def test_one_job_reads_the_headers_of_many_files(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02}.csv").write_text("a,b\n1,2\n" if i % 2 else "b,a\n2,1\n")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = bind_by_name(spark, [str(tmp_path / f"{i:02}.csv") for i in range(40)])
    after = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert len(set(after) - set(before)) < 12
    assert out.groupBy("a", "b").count().collect()[0].asDict() == {"a": 1, "b": 2, "count": 40}


def test_all_files_of_a_result_are_written_by_one_job(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "x, y", None, 1, 1.5), ("a", 'q"r', None, 2, None), ("a,b", "x", "z", 3, 0.1), ("none", "x", "z", 4, 0.2)],
                               "set string, a string, b string, n int, ci95_ll double")
    sets = [["a"], ["a", "b"], [], ["a"]]
    files = sinks.write_sets(df, str(tmp_path), sets)
    assert [os.path.basename(f) for f in files] == ["boot_a.csv", "boot_a,b.csv", "boot.csv", "boot_a.csv"]
    assert sorted(os.listdir(tmp_path)) == ["boot.csv", "boot_a,b.csv", "boot_a.csv"]
    rows = lambda f: sorted(tuple(r) for r in spark.read.option("header", True).csv(f).collect())
    assert spark.read.option("header", True).csv(files[0]).columns == ["a", "n", "ci95.ll"]
    assert rows(files[0]) == [('q"r', "2", None), ("x, y", "1", "1.5")] and rows(files[1]) == [("x", "z", "3", "0.1")]
    assert open(next((tmp_path / "boot.csv").glob("part-*"))).read() == "n,ci95.ll\n"
    # a large file has several parts, each with its header; a second run replaces the first
    monkeypatch.setattr(sinks, "SINGLE_PART_ROWS", 20)
    many = spark.range(100).select(F.lit("a").alias("set"), F.lit("same").alias("a"), F.col("id").alias("n"))
    sinks.write_sets(many, str(tmp_path), [["a"]])
    parts = list((tmp_path / "boot_a.csv").glob("part-*"))
    assert len(parts) == 5 and all(open(p).readline() == "a,n\n" for p in parts)
    assert rows(files[0]) == sorted(("same", str(i)) for i in range(100))

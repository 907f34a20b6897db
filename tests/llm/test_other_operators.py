"""WARC, nearest neighbours, quotation linking and the pipeline on small tables."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bootframe.llm import chat_quotes, nearest_neighbours, store, warc
from bootframe.llm import queries as Q
from tests.conftest import SF_MID, SF_SMALL


def pages(spark):
    big = "<p>" + "x" * 200
    bomb = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(3, "http://a", big), (1, "http://b", big), (2, "u\r\nWARC/1.1\r\n", big), (4, None, None), (5, "x", ""), (6, "x", "short"), (7, "x", "short")]
    rows += [(8, "x", bomb), (9, "x", "WARC/1.1\r\n" * 40 + "WARC/1."), (10, "x", "a\r\n\r\n" * 50 + bomb + "é" * 100), (11, "x", bomb * 30), (12, "x", bomb * 30), (None, "x", big), (13, "y", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("cell,split", [(4 << 20, "128m"), (64, "300")])
def test_warc_round_trip(spark, monkeypatch, cell, split):
    monkeypatch.setattr(warc, "CELL", cell)
    docs = pages(spark)
    path = store.shared_path(spark, "t-warc")
    warc.write_warc(docs.coalesce(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.payloads(warc.read_warc(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    html = {r["page_id"]: (r["html"] or "").encode() for r in docs.collect()}
    first = {}
    for p in sorted(p for p in html if p is not None):
        if len(html[p]) >= 100:
            first.setdefault(html[p], p)
    assert len(got) == len(html)
    for r in got:
        body, of = html[r["page"]], first.get(html[r["page"]])
        again = r["page"] is not None and of is not None and of != r["page"]
        assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (of if again else None)
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert r["payload"] is None if again else bytes(r["payload"]) == body


def test_warc_empty_table_and_broken_file(spark):
    path = store.shared_path(spark, "t-warc")
    warc.write_warc(pages(spark).limit(0), path)
    assert warc.read_warc(spark, path).count() == 0
    path = store.shared_path(spark, "t-warc")
    one = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    spark.createDataFrame([(one + "junk " + one,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    assert [bytes(r["block"]) for r in warc.read_warc(spark, path, "1.0").collect()] == [b"abc"]


def test_warc_query_equals_brute_force(spark):
    got = {r["page_id"]: r for r in Q.op7_warc(spark, SF_MID).collect()}
    rows = duckdb.sql(f"select page_id, html from '{SF_MID}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for p, html in rows:
        assert got[p]["payload_digest"] == hashlib.sha256((html or "").encode()).hexdigest()


def test_nearest_neighbours_exact_scores_ties_and_left_out_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [1.0] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] + [1.0] * 7), (1005, [1.0, 2.0]), (None, [1.0] * 8), (1007, []), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nearest_neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows[:340]}
    assert {x["query_id"] for x in out} == {0, 100, 200, 300}
    hit = 0
    for q in (0, 100, 200, 300):
        mine = [x for x in sorted(out, key=lambda x: x["rank"]) if x["query_id"] == q]
        assert [x["rank"] for x in mine] == list(range(1, 11))
        want = sorted((math.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q)[:10]
        for x in mine:
            assert abs(x["score"] - math.sqrt(((good[q] - good[x["vec_id"]]) ** 2).sum())) < 1e-12
        assert [(x["score"], x["vec_id"]) for x in mine] == sorted((x["score"], x["vec_id"]) for x in mine)
        hit += len({x["vec_id"] for x in mine} & {i for _, i in want})
        if q in (0, 300):
            assert [x["vec_id"] for x in mine] == [i for _, i in want]
    assert hit >= 36


def test_nearest_neighbours_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_neighbours.nearest(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 2, 0.0), (0, 2, 1, 1.0)]
    assert nearest_neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest_neighbours.nearest(df, F.lit(False)).count() == 0


def test_nearest_neighbours_recall(spark):
    got = Q.op6_nearest_neighbours(spark, SF_MID).toPandas()
    d = duckdb.sql(f"select vec_id, embedding from '{SF_MID}/embeddings.parquet'").df()
    x, ids = np.stack(d.embedding.to_list()).astype(float), d.vec_id.to_numpy()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = set(ids[np.lexsort((ids, far))[:10]])
        hit, total = hit + len(want & set(got[got.query_id == ids[q]].vec_id)), total + 10
    assert hit / total >= 0.9


def test_quotes_are_linked_and_taken_out(spark):
    rows = [
        (1, 0, "user", "How do I bake a good loaf of bread?\nI have flour and water only."),
        (1, 1, "assistant", "Mix them well and let the dough rest overnight."),
        (1, 2, "user", "> Mix them well and let the dough\n> rest overnight.\n\nFor how many hours exactly?"),
        (1, 3, "assistant", "On Monday X wrote:\n> > Mix them well and let the dough rest overnight.\n> For how many hours exactly?\nAbout twelve hours."),
        (1, 4, "user", "> I have flour and water only.\nAnd salt, I found some."),
        (1, 5, "user", "> words that nobody ever said here\nHm."),
        (2, 0, "user", "> About twelve hours.\nanother conversation"),
        (2, 1, "user", None), (2, 2, "user", ""), (2, 2, "user", "same turn, other words"), (None, 1, "user", "> About twelve hours."), (3, None, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Path", F.lit(1)).withColumn("c", F.lit("kept"))
    out = chat_quotes.reply_order(df)
    got = {(r["conv_id"], r["turn"], r["text"]): r for r in out.collect()}
    assert len(got) == len(rows) and out.columns.count("path") == 1 and "c" in out.columns
    at = lambda i: got[rows[i][0], rows[i][1], rows[i][3]]
    assert [at(i)["reply_to"] for i in range(12)] == [None, None, 1, 2, 0, None, None, None, None, None, None, None]
    assert [at(i)["path"] for i in range(6)] == [[0], [1], [1, 2], [1, 2, 3], [0, 4], [5]]
    assert at(3)["own"] == "About twelve hours." and at(3)["quote_levels"] == 2 and at(2)["own"] == "For how many hours exactly?"
    assert at(7)["own"] is None and at(8)["own"] == ""
    chat = {(r["conv_id"], r["thread"]): [m["content"] for m in r["messages"]] for r in chat_quotes.chats(out.where("conv_id = 1")).collect()}
    assert chat[1, 1] == ["Mix them well and let the dough rest overnight.", "For how many hours exactly?", "About twelve hours."]
    assert chat_quotes.reply_order(df.limit(0)).count() == 0


def test_short_messages_and_sentences_are_quoted(spark):
    rows = [
        (1, 0, "Yes, I do."), (1, 1, "Shall we meet at noon? The train leaves early. Bring the big umbrella."), (1, 2, "Yes, I do."),
        (1, 3, "> Yes, I do.\nGood."), (1, 4, "> The train leaves early.\nHow early?"), (1, 5, "> The train leaves early. Bring the big umbrella.\nWhy?"), (1, 6, "> No\nHm."), (1, 7, "> Good.\nSo it is."),
    ]
    out = chat_quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert {r["turn"]: r["reply_to"] for r in out.collect()} == {0: None, 1: None, 2: None, 3: 2, 4: 1, 5: 1, 6: None, 7: 3}


def test_pipeline_runs_and_keeps_distinct_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = store.stored(out, "t-stage")
        seen[name] = docs.count()
    assert seen["language_id"] == 200 and seen["line_dedup"] >= seen["ngram_jaccard"] > 150
    assert docs.where("n_tokens is null or size(ids) <> n_tokens").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "n_tokens").collect())) == sorted(map(str, docs.select("doc_id", "n_tokens").collect()))


def test_reply_order_and_mixed_documents_keep_columns_of_any_name(spark):
    from bootframe.llm import mixing

    said = [(1, 0, "u", "Where is the small blue boat now?", 5, "a"), (1, 1, "v", "> Where is the small blue boat now?\nAt the pier.", 6, "b")]
    out = chat_quotes.reply_order(spark.createDataFrame(said, "conv_id long, turn long, role string, text string, levels int, matched string"))
    got = {r["turn"]: r for r in out.collect()}
    assert got[1]["reply_to"] == 0 and got[1]["levels"] == 6 and got[1]["matched"] == "b" and got[0]["reply_to"] is None
    docs = spark.createDataFrame([(i, "a b c", "s", i * 10) for i in range(8)], "doc_id long, text string, source string, col int")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and all(r["col"] == 10 * r["doc_id"] for r in mixed.collect())
    with_long = nearest_neighbours.nearest(spark.createDataFrame([(i, [float(i) + 1e-9 * i, 1.0]) for i in range(1, 30)], "vec_id long, embedding array<double>"), F.col("vec_id") == 1, k=3)
    for r in with_long.collect():
        assert r["score"] == pytest.approx(r["vec_id"] - 1 + 1e-9 * (r["vec_id"] - 1), abs=1e-14)


def test_letters_are_letters():
    from bootframe.llm import language_id

    assert language_id.word_list("² ½ ① Ⅳ 12") == [] and language_id.word_list("ab²c Ⅳx é") == ["ab", "c", "x", "é"]
    assert language_id.word_list(None) == [] and language_id.word_list("Ab c_d") == ["ab", "c", "d"]

"""Filter audit, centroid clusters and HTML extraction against brute force, SQL and held-out pages."""

import hashlib
import html
import math
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from bootframe.llm import centroid_clusters, filter_audit, html_text
from bootframe.llm import queries as Q
from tests.conftest import SF_MID, SF_SMALL


def oracle(sql, tables, sf=SF_SMALL):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    return {tuple(dict(zip(rel.columns, r))[c] for c in sorted(rel.columns)) for r in rel.fetchall()}


def rows(df):
    return [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]


# filter audit


def test_lattice_counts_paths():
    for k in (1, 3, 5):
        edges = {(s, i): (a, b) for s, i, a, b in filter_audit.lattice(k)}
        assert len(edges) == k * 2 ** (k - 1)
        for (s, i), (a, b) in edges.items():
            size = bin(s).count("1")
            assert (a, b) == (math.factorial(size), math.factorial(k - size - 1))


def fails_by_force(docs):
    """Failed letters of each row (id, text, ...), as the contract words them."""
    out = []
    for doc, text, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, *_ in docs)}
        out.append({k for k, v in f.items() if v})
    return out


def audit_by_force(docs, labels):
    fails = fails_by_force(docs)
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    out = []
    for part in {p or "" for _, _, p, *_ in docs}:
        mine = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        counted = []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                failing = sum(x in f for _, f in mine)
                counted.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in mine), sum(d in good for d in gone), sum(d in toxic for d in gone), x))
        worth = {x: sum(c[4] for c in counted if c[9] == x) for x in "ABCDE"}
        out += [dict(zip(("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), c), shapley=worth[c[9]]) for c in counted]
    return sorted(tuple(r[k] for k in sorted(r)) for r in out)


def test_filter_audit_equals_brute_force(spark):
    r = random.Random(1)
    long = " ".join(f"w{i}" for i in range(150))
    texts = [None, "", "a", "A B", long, long, long + " $", " ".join(["x"] * 120), "ABC" * 50, "é" * 20 + "  B", " ".join(f"w{i}" for i in range(20_000)), "a b"]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["en", "de", None, ""]), 1, "k") for _ in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int, key string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(rows(filter_audit.audit(df, marks))) == audit_by_force(docs, labels)
    assert sorted(rows(filter_audit.audit(df, marks.limit(0)))) == audit_by_force(docs, [])
    assert filter_audit.audit(df.limit(0), marks).count() == 0


def test_filter_audit_query_equals_sql(spark):
    got = rows(Q.op13_filter_audit(spark, SF_SMALL))
    want = oracle(Q.ORACLE_SQL["op13_filter_audit"], ["documents", "labels"])
    assert len(got) == 600 * 4 and set(got) == want


def test_interactions_takes_other_filters(spark):
    masks = spark.createDataFrame([("p", 0b01, 4, 1, 0), ("p", 0b11, 2, 0, 2), ("p", 0, 10, 5, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.interactions(masks, "XY").collect()}
    assert {k: (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for k, r in got.items()} == {("XY", 1): (10, 6, 0, 4, 10), ("XY", 2): (10, 0, 2, 0, 2), ("YX", 1): (14, 2, 0, 0, 2), ("YX", 2): (10, 4, 2, 4, 10)}
    with pytest.raises(ValueError):
        filter_audit.interactions(masks, "XX")


# centroid clusters


def clusters_by_force(vectors, dim, k, rounds, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "z"
    centroids = [v for _, v in sorted(kept, key=lambda x: (mark(x[0]), x[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else old for c, old in enumerate(centroids)]
    found = [(i, c, far(v, centroids[c])) for i, v in kept for c in [nearest(v)]]
    whole = sum(d for *_, d in found)
    return [(hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest(), c, sum(d for _, x, d in found if x == c), d, whole, i) for i, c, d in found]


def order(xs):
    return sorted(xs, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("big", [1.0, 4e5, 1e12])
def test_centroid_clusters_equal_brute_force(spark, big):
    r = random.Random(3)
    vectors = [(i, [r.choice([-1.5, -0.3, 0.0, 0.25, 1.0, r.uniform(-2, 2)]) * big for _ in range(4)]) for i in range(150)]
    vectors += [(7, vectors[7][1]), (None, vectors[9][1]), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0]), (204, [1.0, math.nan, 0.0, 0.0]), (205, [math.inf, 0.0, 0.0, 0.0]), (206, [0.0] * 4), (207, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, id string, distance int").repartition(5)
    got = order(rows(centroid_clusters.clusters(df, dim=4, k=6, rounds=3, scale=64)))
    want = clusters_by_force(vectors, 4, 6, 3, 64)
    if big == 1e12:  # distances beyond 64 bits are null
        want = [(h, c, None if s >= 2**63 else s, None if d >= 2**63 else d, None, i) for h, c, s, d, w, i in want]
        got = [(h, c, s, d, w, i) for h, c, s, d, w, i in got]
        assert [(g[0], g[1], g[3], g[5]) for g in got] == [(w[0], w[1], w[3], w[5]) for w in order(want)]
        return
    assert got == order(want)


def test_bisectors_ties_go_to_the_smaller_number():
    b = centroid_clusters.Bisectors([[2, 0], [0, 0], [2, 0], [-2, 0]])
    nearest, far = b.nearest(np.array([[1, 0], [-1, 5], [2, 0], [0, 0]]))
    assert nearest.tolist() == [0, 1, 0, 1] and far.tolist() == [1, 26, 0, 0]


def test_centroid_clusters_small_tables(spark):
    df = spark.createDataFrame([(5, [0.5] * 64), (6, [0.5] * 64), (7, [-0.01] * 64)], "vec_id int, embedding array<float>")
    got = order(rows(centroid_clusters.clusters(df)))
    assert got == order(clusters_by_force([(r["vec_id"], r["embedding"]) for r in df.collect()], 64, 16, 3, 64))
    empty = centroid_clusters.clusters(df.limit(0))
    assert empty.count() == 0 and empty.columns == centroid_clusters.clusters(df).columns


def test_centroid_clusters_query_equals_sql(spark):
    got = rows(Q.op12_centroid_clusters(spark, SF_MID))
    want = oracle(Q.ORACLE_SQL["op12_centroid_clusters"], ["embeddings"], SF_MID)
    assert len(got) == len(want) == 500 and set(got) == want


# html extraction


def article(page):
    """The lines of a page whose article is one plain element."""
    found = re.split(r"</?(?:p|h1)\b[^>]*>", page.split("<article>")[1].split("</article>")[0]) if "<article>" in page else []
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in found]
    return "\n".join(x for x in lines if x)


def test_html_query_equals_the_article_of_every_page(spark):
    got = {r["page_id"]: r for r in Q.op11_html_text(spark, SF_MID).collect()}
    pages = duckdb.connect().execute(f"select page_id, url, html from '{SF_MID}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for i, url, page in pages:
        assert got[i]["text"] == article(page) and got[i]["n_chars"] == len(article(page)) and got[i]["url"] == url


@pytest.fixture(scope="module")
def model():
    pages = duckdb.connect().execute(f"select html from '{SF_MID}/pages.parquet' order by page_id").fetchall()
    return html_text.fitted([p for (p,) in pages[:128]]), [article(p).split("\n") for (p,) in pages[128:]]


def test_held_out_layouts(model):
    model, texts = model
    layouts = html_text.Layouts([t for ts in texts for t in ts], 5)
    reader, right, n = html_text.Reader(), 0, 0
    for ts in texts:
        page, labels = layouts.page(ts[:15])
        found = reader.blocks(page)
        assert len(found) == len(labels)
        keep = model.logits(*html_text.padded([reader.vectors([found])]))[:, 0] > 0
        right, n = right + int((keep == np.array(labels)).sum()), n + len(labels)
    assert n > 1500 and right / n > 0.95


def test_article_among_other_elements(model):
    model, texts = model
    a, b, c, d = (t[:400] for t in sorted((t for ts in texts for t in ts), key=len)[-4:])
    page = f"""<html><head><title>{a}</title><style>p > b {{}}</style></head><body><header><div class="site-title">{a[:20]}</div></header>
    <nav><ul><li><a href="/1">Home</a><li><a href="/2" title="a > b">Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies <button>Accept</button></p></div>
    <article><h1>{b[:40]} &amp; &#233;&nbsp;x</h1><p>{c}<p><b>{d}</b> <i>more</i><br>
    text <!-- <p>not this</p> --><script>var x = "</p>";</script><div class="ad">{a}</div><p>{b}</p></article>
    <aside><h3>Related</h3><p>{d[:60]}</p></aside><section class="comments"><h2>Comments</h2><p>{c[:80]}</p></section><form><label>{a[:10]}</label><textarea>{a}</textarea></form>
    <footer>&copy; {a[:30]}</footer></body></html>"""
    got = html_text.articles(model, html_text.Reader(), [page])[0].split("\n")
    one = lambda x: " ".join(x.split())
    assert got == [one(f"{b[:40]} & é x"), one(c), one(f"{d} more text"), one(b)]


def test_blocks_of_broken_pages():
    texts = lambda page: [t for t, _, _ in html_text.blocks(page, html_text.Paths())]
    assert texts("a < b <1> c<p>x<p>y</i></p>z</div> <") == ["a < b <1> c", "x", "y", "z", "<"]
    assert texts('<p title="a>b">x</p><p title="a>y<p>z') == ["x", "y", "z"]
    assert texts("<script>x</p>") == [] and texts("<!-- x <p>y") == [] and texts("<!-->a--><p>&lt;p&gt; &#x41; &nbsp; b") == ["a-->", "<p> A b"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<b><p>x</b>y</p>" * 3) == ["xy"] * 3
    deep = "<div>" * 20_000 + "x" + "</section>" * 20_000
    assert texts(deep) == ["x"]


def test_lstm_gradients():
    r = np.random.default_rng(0)
    m = html_text.BiLSTM(5, 3, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = r.normal(size=(6, 2, 5)), np.array([[True] * 2] * 4 + [[True, False]] * 2)
    want, weight = r.integers(0, 2, (6, 2)).astype(float), mask.astype(float)
    _, g = m.gradients(x, mask, want, weight)
    for k, v in m.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 8)]:
            old = v[at]
            v[at] = old + 1e-5
            up = m.gradients(x, mask, want, weight)[0]
            v[at] = old - 1e-5
            down = m.gradients(x, mask, want, weight)[0]
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_html_edges(spark, model):
    model, texts = model
    page = f"<body><article><p>{texts[0][0]}</article>"
    big = "<body><article>" + "".join(f"<p>{t}" for ts in texts for t in ts) * 3 + "</article>"
    data = [(1, "u", None, "a", 1), (2, None, "", "a", 2), (None, "u", page, "a", 3), (3, "u", page, "a", 4), (3, "u", page, "a", 4), (4, "u", big, "a", 5)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string, `n.chars` int")
    got = html_text.main_text(df, model).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "n.chars", "text", "n_chars"}
    by = {r["n.chars"]: r for r in got}
    assert len(got) == 6 and by[1]["text"] == by[2]["text"] == "" and by[1]["n_chars"] == 0
    assert by[3]["text"] == by[4]["text"] == texts[0][0]
    assert by[5]["text"] == "\n".join([t for ts in texts for t in ts] * 3)
    assert html_text.fit(df.limit(0)) is None and html_text.main_text(df.limit(0), None).count() == 0

"""Operators on documents against brute force, on small tables with awkward rows."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from bootframe.llm import document_fingerprints as fp
from bootframe.llm import language_id, line_dedup, linking, mixing, ngram_jaccard, sentencepiece_codec, store, substring_dedup
from bootframe.llm import queries as Q
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `N_Shingles` int, fingerprint string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def table(spark, texts, sources=None, langs=None, ids=None):
    rows = [((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def awkward():
    long = " ".join(words(1, 3000, 10_000))
    near = long.split()
    near[100] = "changed"
    return [None, "", "   \n\t ", "one", "one", "One two", "a b c", "A  B\tC", long, " ".join(near), "é ▁ ﬁ x\x00y", "x\ny\nx\n\n", "<s> </s> <unk> <0x0A> ▁▁ a   b "]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components_by_force(sets, percent):
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    return [find(parent, i) for i in range(len(sets))]


@pytest.mark.parametrize("left_out", [0, 1, 2])
@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_jaccard_groups_equal_brute_force(spark, n, percent, left_out):
    texts = awkward()
    for g in range(6):
        base = words(g, random.Random(g).randrange(3, 300))
        for c in range(7):
            w = list(base)
            r = random.Random(g * 100 + c)
            for _ in range(r.randrange(0, 2 + len(w) // 25)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in ngram_jaccard.jaccard_groups(table(spark, texts), n=n, percent=percent, left_out=left_out).collect()}
    sets = [shingles(t, n) for t in texts]
    want = components_by_force(sets, percent)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_sets_that_link_share_a_signature_and_pass_the_parity_bound():
    r = np.random.default_rng(5)
    for percent, left_out in ((80, 0), (80, 1), (90, 1), (90, 2)):
        sign = ngram_jaccard.Signer(percent, left_out)
        for size in (1, 2, 4, 5, 9, 10, 11, 30, 150, 999):
            for _ in range(20):
                both = r.integers(0, 2**64, size, np.uint64)
                most = (100 - percent) * size // percent
                only = r.integers(0, 2**64, most, np.uint64)
                cut = r.integers(0, most + 1)
                x, y = np.unique(np.concatenate([both, only[:cut]])), np.unique(np.concatenate([both, only[cut:]]))
                assert set(sign(x)) & set(sign(y))
                bits = ngram_jaccard.parities([x, y])
                differ = sum(bin((int(b[0]) ^ int(b[1])) % 2**64).count("1") for b in bits.values())
                assert differ <= most and differ % 2 == most % 2


def test_ngram_jaccard_counts_every_link_of_a_group(spark):
    base = words(6, 200, 10_000)
    texts = [" ".join(words(7, 200, 10_000))]
    for i in range(9):
        w = list(base)
        w[5 + 9 * (i // 2)] = f"changed{i}"
        w[150 - i] = "x" if i < 8 else w[150 - i]
        texts.append(" ".join(w))
    texts.append(texts[-1])
    sets = [shingles(t, 3) for t in texts]
    distinct = {frozenset(x) for x in sets}
    want = [sum(x != y and 100 * len(x & y) >= 90 * len(x | y) for y in distinct) for x in map(frozenset, sets)]
    got = {r["doc_id"]: r["n_links"] for r in ngram_jaccard.jaccard_groups(table(spark, texts), n=3, percent=90, count_links=True).collect()}
    assert max(want) >= 5 and got == dict(enumerate(want))


def test_ngram_jaccard_repeated_null_ids_and_empty_table(spark):
    a, b = " ".join(words(1, 50)), " ".join(words(2, 50))
    docs = table(spark, [a, b, b, None, a], ids=[7, 7, 9, None, None])
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_jaccard.jaccard_groups(docs, n=3, percent=90).collect())
    assert got == [("7", "7"), ("7", "7"), ("9", "7"), ("None", "None"), ("None", "None")]
    assert ngram_jaccard.jaccard_groups(docs.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in ngram_jaccard.one_per_group(docs, n=3, percent=90).collect()) == ["7", "7", "None", "None"]


def test_components_of_long_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (None, 3)]
    work = store.Workspace(spark, "t")
    got = {r["node"]: r["component"] for r in linking.components(spark.createDataFrame(edges, "a long, b long"), work).collect()}
    work.close()
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)}


def test_last_round_in_slices_with_marks_finds_the_same_links(spark):
    members = spark.createDataFrame([("k", i, 0) for i in range(60)] + [("l", i, 7) for i in range(7, 20)], "key string, node long, low long")
    marks = spark.createDataFrame([(i, i % 4) for i in range(60)], "node long, of int").select("node", F.struct("of").alias("mark"))
    verify = lambda pairs: pairs.where("a > 0 and a % 4 = b % 4 and abs(a - b) = 4")
    work = store.Workspace(spark, "t")
    group, _ = linking.linked_components(work.stored(members, "m"), verify, work, pivots=0, marks=marks, fits=lambda a, b: F.col(f"{a}.of") == F.col(f"{b}.of"), slice_rows=7)
    got = {r["node"]: r["component"] for r in group.collect()}
    work.close()
    assert got == {i: i % 4 or 4 for i in range(5, 60)}


def test_bucket_whose_pivot_links_nothing_still_finds_all_links(spark):
    members = spark.createDataFrame([("k", i, 0) for i in range(40)], "key string, node long, low long")
    work = store.Workspace(spark, "t")
    verify = lambda pairs: pairs.where("a > 0 and a % 2 = b % 2 and abs(a - b) = 2")
    group, links = linking.linked_components(work.stored(members, "m"), verify, work, pivots=2)
    got = {r["node"]: r["component"] for r in group.collect()}
    work.close()
    assert got == {i: 1 + (i + 1) % 2 for i in range(3, 40)}


def test_sieve_passes_every_key_in_it(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    out = store.sifted(spark.range(5000), F.col("id"), store.sieve(keys, "k"))
    assert out.where("__in and id % 7 = 0").count() == keys.count()
    assert out.where("not __in").count() > 4200


def test_line_dedup_equals_brute_force(spark):
    base = [" ".join(words(g, 30 + g)) for g in range(12)]
    texts = awkward()
    for g, line in enumerate(base):
        w = line.split()
        w[4] = "other"
        texts += [f"{line}\nfoot {g} {'x' * g} y z", f"{' '.join(w)}\n{base[(g + 3) % 12].upper()}!", f"{line}\n{line}"]
    docs = table(spark, texts)
    lines = [(d, n, ws) for d, t in enumerate(texts) if t for n, ws in enumerate(line_dedup.normalised_lines(t)) if len(ws) >= 3]
    forms = sorted({b" ".join(ws) for _, _, ws in lines})
    sims = line_dedup.simhashes([f.split() for f in forms], ngram_jaccard.WordHashes())
    parent, con = list(range(len(forms))), duckdb.connect()
    for i, a in enumerate(forms):
        for j, b in enumerate(forms[:i]):
            if bin((int(sims[i]) ^ int(sims[j])) % 2**64).count("1") <= 3:
                x, y = a.decode(), b.decode()
                far = con.execute("select levenshtein(?, ?)", [x, y]).fetchall()[0][0]
                if far * 100 <= 20 * max(len(x), len(y)):
                    p, q = sorted((find(parent, i), find(parent, j)))
                    parent[q] = p
    first, gone = {}, set()
    for d, n, ws in lines:
        group = find(parent, forms.index(b" ".join(ws)))
        if group in first:
            gone.add((d, n))
        first.setdefault(group, (d, n))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert gone
    for d, t in enumerate(texts):
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
        assert got[d]["text"] == want
        assert got[d]["lines_removed"] == sum(a == d for a, _ in gone)
        assert (got[d]["N_Shingles"], got[d]["fingerprint"]) == (1, "x")


def test_line_dedup_links_near_lines_and_counts_repeats(spark):
    long = " ".join(words(3, 400))
    near = long.replace("w1 ", "q1 ", 1)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, [long, near + "\nkept line of its own", long + "!"])).collect()}
    assert got[0] == long and got[2] == ""
    assert got[1] in ("kept line of its own", near + "\nkept line of its own")
    assert line_dedup.dedup_lines(table(spark, ["a"]).limit(0)).count() == 0


def edited(r, line, letters):
    for _ in range(letters):
        i = r.randrange(len(line))
        line = r.choice([line[:i] + "q" + line[i + 1 :], line[:i] + line[i + 1 :], line[:i] + "z" + line[i:]])
    return line


def test_lines_of_80_percent_edit_similarity_share_a_key():
    r = random.Random(8)
    base = [" ".join(r.choice(["ab", "cd", "efg", "hijk", "lm", "no"]) for _ in range(r.randint(3, 6)))[:20] for _ in range(150)]
    short = sorted({b" ".join(line_dedup.normalised_lines(x)[0]).decode() for x in base + [edited(r, x, r.randint(1, 4)) for x in base]})
    keys = {f: line_dedup.segment_keys(f, 80) for f in short}
    assert max(map(len, short)) <= line_dedup.SHORT
    con = duckdb.connect()
    con.execute("create table f as select unnest(?) as s", [short])
    linked = con.execute("select a.s, b.s from f a join f b on a.s < b.s and levenshtein(a.s, b.s) * 100 <= 20 * greatest(length(a.s), length(b.s))").fetchall()
    assert len(linked) > 100 and all(keys[a] & keys[b] for a, b in linked)


def test_line_dedup_by_edit_similarity_links_lines_with_a_changed_word(spark):
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(6 + 5 * i)) for i in range(16)]
    near = [" ".join(["qqqqq" if i == 3 else w for i, w in enumerate(x.split())]) for x in texts]
    got = {row["doc"]: row["keep"] for row in line_dedup.repeated_lines(table(spark, texts + near), near="edit").collect()}
    con = duckdb.connect()
    far = [con.execute("select levenshtein(?, ?) * 100 > 20 * greatest(length(?), length(?))", [x, y, x, y]).fetchall()[0][0] for x, y in zip(texts, near)]
    assert sum(far) <= 1 and got == {d: d < 16 for d in range(32) if not far[d % 16]}


def test_line_dedup_takes_lines_of_few_words(spark):
    said = "これは空白のない一つの文であり最後まで同じです"
    texts = ["Yes\n7\n---\n\nNo, never", said + "\nyes!\n8\n***\n\n", said[:-1] + "だ\nno never\n7\n---\nown"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, texts), near="edit", min_words=0).collect()}
    assert got == {0: texts[0], 1: said + "\n8\n***\n\n", 2: "own"}


def test_simhash_of_a_long_line_counts_votes_beyond_a_byte():
    hashes = ngram_jaccard.WordHashes()
    line = [w.encode() for w in words(1, 1000, 50)]
    h = np.array([hashes[w] for w in line], np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    votes = np.unpackbits(ngram_jaccard.mixed(h + ngram_jaccard.mixed(before + np.uint64(3))).view(np.uint8).reshape(-1, 8), axis=1)
    want = np.packbits(votes.sum(axis=0).astype(int) * 2 > len(line)).view(np.int64)[0]
    assert line_dedup.simhashes([[b"x"], line, [b"y", b"z"]], hashes)[1] == want


def mix_by_force(rows, weights, percent, epochs):
    """rows: (id, size, source); the level by bisection."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size = {s: sum(z for _, z, x in rows if x == s) for s in names}
    budget, lo, hi = sum(size.values()) * percent / 100, 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(epochs * size[s], weight[s] * mid) for s in names) < budget else (lo, mid)
    return {s: min(epochs * size[s], weight[s] * hi) for s in names}


def test_mixing_meets_targets_and_repeats(spark):
    r = random.Random(5)
    sources = [r.choice(["b", "a", "z", None, "Z", "é"]) for _ in range(600)]
    texts = [None if i % 50 == 0 else " ".join(words(i, r.randrange(0, 30))) for i in range(600)]
    docs = table(spark, texts, sources)
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda x: (x["doc_id"], x["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    sizes = [(i, len((t or "").split()), s) for i, (t, s) in enumerate(zip(texts, sources))]
    targets = mix_by_force(sizes, (5, 2, 1), 150, 2)
    by = {i: (z, s) for i, z, s in sizes}
    taken = {}
    for x in out:
        z, s = by[x["doc_id"]]
        assert (x["size"], x["source"]) == (z, s) and x["taken"] in (0, z, 2 * z)
        assert abs(x["target"] - targets[s]) < 1e-6 * max(1, targets[s])
        taken[s] = taken.get(s, 0) + x["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 60
    assert sum(x["taken"] for x in out) == pytest.approx(sum(targets.values()), abs=31)
    assert mixing.mixed_documents(docs).count() == sum(x["times"] for x in out)


def test_mixing_small_and_equal_rows(spark):
    docs = table(spark, ["a b", "a b", "a b", None, ""], ["s"] * 5, ids=[1, 1, 1, None, 2])
    out = mixing.mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in out if r["size"]) == [("1", 2), ("1", 2), ("1", 4)] or sum(r["taken"] for r in out) in (8, 10)
    assert mixing.mixed_documents(docs).count() == sum(r["times"] for r in out)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.where("text is null")).collect()} == {0}


def test_sentencepiece_equals_the_library(spark):
    texts = awkward() + [r[0] for r in duckdb.sql(f"select text from '{SF_SMALL}/documents.parquet' limit 60").fetchall()]
    sp = spm.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    assert sentencepiece_codec.words_are_separate(sp)
    docs = table(spark, texts)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, Q.PIECE_MODEL), Q.PIECE_MODEL).collect()
    digests = {r["doc_id"]: r for r in sentencepiece_codec.round_trip(docs, Q.PIECE_MODEL, ids_col="N_shingles").collect()}
    for r in both:
        ids = sp.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids)
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(ids) and d["N_shingles"] == ids and d["fingerprint"] == "x"
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.round_trip(docs.limit(0), Q.PIECE_MODEL).count() == 0


def test_sentencepiece_table_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "WORDS_KEPT", 5)
    t = sentencepiece_codec.WordTable(Q.PIECE_MODEL)
    texts = [" ".join(words(i, 9)) for i in range(6)]
    assert [ids for x in texts for ids in t.ids([x])] == t.sp.encode(texts)


def test_language_id_on_held_out_documents(spark):
    out = Q.op9_language_id(spark, SF_SMALL.replace("0.001", "0.01"))
    pdf = out.toPandas()
    lang = duckdb.sql(f"select doc_id, lang from '{SF_SMALL.replace('0.001', '0.01')}/documents.parquet'").df()
    met = pdf.merge(lang, on="doc_id")
    held = met[met.held_out]
    assert len(met) == 1000 and 150 < len(held) < 350
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert ((met.score >= 0) & (met.score <= 1)).all() and not met.rejected.any()


def test_language_id_edges(spark):
    en, de = "the cat sat on the mat and the dog ran home again", "der hund lief nach hause und die katze schlief ein"
    docs = table(spark, [en, de] * 40 + [None, "", "123 ..", "qxz wvk jqq zzx " * 40], langs=["en", "de"] * 40 + ["en", None, "de", None])
    model = language_id.fit(docs)
    out = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 80, 81, 82)] == ["en", "de", "und", "und", "und"]
    assert out[83]["rejected"] and out[80]["rejected"] and not out[0]["rejected"] and out[80]["entropy"] is None
    assert language_id.fit(docs.limit(0)) is None
    assert language_id.identify(docs.limit(2), None).first()["lang_pred"] == "und"
    assert out[0]["N_Shingles"] == 1


def test_kneser_ney_probabilities_sum_to_one():
    counts = {}
    for w in ["^abab$", "^abc$", "^cab$", "^b$"]:
        for end in range(2, len(w) + 1):
            g = w[max(0, end - 3) : end]
            counts[g] = counts.get(g, 0) + 1
    model = language_id.KneserNey({"x": counts}, 3)
    # the next letter after "ab", over all letters that the model knows
    total = 0.0
    for ch in "abc$":
        one, _ = model.word_scores([f"ab{ch}"]) if ch != "$" else model.word_scores(["ab"])
        before, _ = model.word_scores(["ab"])
        hashes, _ = language_id.gram_hashes([f"ab{ch}" if ch != "$" else "ab"], 3)
        p = model.floor[0]
        for n in range(3):
            if n:
                at, hit = model._find(n - 1, model._context(hashes, np.zeros(len(hashes[0]), int), n))
                p = p + (model.back[n - 1][at[2], 0] if hit[2] else 0)
            at, hit = model._find(n, hashes[n])
            if hit[2] and not np.isnan(model.logp[n][at[2], 0]):
                p = model.logp[n][at[2], 0]
        total += np.exp(p)
    assert 0.95 < total <= 1.0001


def omh_by_force(text, k, l, m):  # noqa: E741
    o = fp.OrderMinHash(k, l, m)
    w = min(k, len(text))
    mers = [text[i : i + w] for i in range(len(text) - w + 1)]
    seen, keys = {}, []
    for x in mers:
        seen[x] = seen.get(x, -1) + 1
        keys.append((x, seen[x]))
    h = o.numbered(text)
    assert len(set(zip(keys, h.tolist()))) == len(set(keys)) == len(set(h.tolist()))
    out = []
    for f, a in zip(o.flip.ravel().tolist(), o.factor.ravel().tolist()):
        v = [(((int(x) >> 32) ^ f) * a % 2**32, i) for i, x in enumerate(h)]
        picked = sorted(i for _, i in sorted(v)[:l])
        total = np.zeros(1, np.uint64)
        for i in picked:
            total = ngram_jaccard.mixed(total ^ h[i])
        out.append(int(total[0]) >> 32)
    return np.array(out, np.uint32)


def test_fingerprints_equal_brute_force(spark):
    texts = ["", "a", "abcabcabcabc" * 4, " ".join(words(1, 200, 20)), "é" * 30, "\U0001f600 x" * 9]
    for t in texts:
        assert (fp.OrderMinHash(5, 2, 8)(t) == omh_by_force(t, 5, 2, 8)).all()
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(table(spark, [*texts, None]), k=5, m=8).collect()}
    assert got[0] == got[6] and got[3] == fp.as_text(fp.OrderMinHash(5, 2, 8)(texts[3]))


@pytest.mark.parametrize("rows", [2000, 3])
def test_fingerprints_of_edited_texts(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    texts = [*awkward(), *[" ".join(words(i, 40)) for i in range(20)]]
    ids = random.Random(1).sample(range(-50, 1000), len(texts))
    got = {r["doc_id"]: r for r in fp.compared_with_next(table(spark, texts, ids=ids)).collect()}
    order = sorted(range(len(texts)), key=lambda i: -ids[i])
    omh = fp.OrderMinHash()
    assert len(got) == len(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        a, b = texts[i] or "", texts[j] or ""
        cut = len(a) // 3
        edited = a[: len(a) - cut] + b[:cut]
        r = got[ids[i]]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.as_text(omh(a)) and r["edited_fingerprint"] == fp.as_text(omh(edited))
        assert r["near_edited"] == fp.likeness(omh(a), omh(edited)) and r["near_next"] == fp.likeness(omh(a), omh(b))
    assert fp.compared_with_next(table(spark, ["x y"])).first()["near_next"] == 1.0
    assert fp.compared_with_next(table(spark, ["x"]).limit(0)).count() == 0


def test_compact_windows_equal_brute_force():
    r = np.random.default_rng(3)
    texts = [r.integers(1, 40, n).astype(np.uint64) for n in (0, 3, 9, 30, 31, 64)]
    got = set(zip(*[x.tolist() for x in substring_dedup.compact_windows(texts, 5, 0)]))
    want = set()
    for t, text in enumerate(texts):
        v = np.maximum(ngram_jaccard.mixed(text ^ ngram_jaccard._odd(1000)), np.uint64(1))
        todo = [(0, len(v) - 1)]
        while todo:
            a, z = todo.pop()
            if z - a + 1 >= 5:
                c = a + int(np.argmin(v[a : z + 1]))
                want.add((int(v[c]), t, a, c, z))
                todo += [(a, c - 1), (c + 1, z)]
    assert got == want


def test_passage_with_six_words_changed_in_the_middle_is_one():
    hashes = ngram_jaccard.WordHashes()
    for size in range(94, 106):
        w = words(size, size, 10**6)
        near = w[: size // 2 - 3] + [f"changed{i}" for i in range(6)] + w[size // 2 + 3 :]
        for before in (0, 120):
            a, b = (substring_dedup.token_hashes(" ".join(words(9, before, 10**6) + x), 5, hashes) for x in (w, near))
            if before:
                b = b[before:]
            start, end = before, before + size - 5
            both = len(np.intersect1d(a[start:], b))
            got = substring_dedup.passages(a[start:], b, 5, 46, 80)
            assert both * 100 >= 80 * (2 * (size - 4) - both)
            assert got == [(0, end - start, 0, size - 5, both / (2 * (size - 4) - both))]


def test_repeated_passages_are_found_and_others_left(spark):
    passage = words(77, 70, 10_000)
    near = list(passage)
    near[35] = "changed"
    texts = [None, "", "short text"] + [" ".join(words(i, 300, 10_000)) for i in range(20)]
    for at, p in ((5, passage), (9, passage), (14, near), (17, passage)):
        w = texts[at].split()
        texts[at] = " ".join(w[:100] + p + w[100:])
    texts.append(" ".join(words(200, 30, 9999) + passage[:40] + words(201, 30, 9999)))
    out = substring_dedup.repeated_passages(table(spark, texts)).collect()
    assert {r["doc"] for r in out} == {9, 14, 17}
    for r in out:
        assert r["of_doc"] == 5 and r["first_word"] == 100 and r["n_words"] == 70 and r["of_first_word"] == 100
    assert substring_dedup.repeated_passages(table(spark, texts).limit(0)).count() == 0


def test_paired_windows_hold_each_stretch_once_under_its_two_minima():
    r = np.random.default_rng(8)
    texts = [r.integers(1, 40, n).astype(np.uint64) for n in (0, 3, 9, 30, 31, 64)] + [np.full(20, 7, np.uint64)]
    key, which, left, centre, right = (x.tolist() for x in substring_dedup.paired_windows(texts, 5, 1))
    for t, text in enumerate(texts):
        one, two = (np.maximum(ngram_jaccard.mixed(text ^ ngram_jaccard._odd(1000 + f)), np.uint64(1)) for f in (2, 3))
        for s in range(len(text) - 4):
            c = s + int(np.argmin(one[s : s + 5]))
            want = ngram_jaccard.mixed(ngram_jaccard.mixed(one[c : c + 1] + ngram_jaccard._odd(2001)) * ngram_jaccard._odd(2101) + two[s : s + 5].min())
            assert sum(w == t and l <= s and s + 4 <= z and m == c and k == int(want[0]) for k, w, l, m, z in zip(key, which, left, centre, right)) >= 1


def test_stretch_hashes_are_equal_for_equal_stretches_only():
    text = np.random.default_rng(5).integers(0, 3, 300).astype(np.uint64)
    for least in (1, 2, 7, 46):
        got = substring_dedup.stretch_hashes(text, least)
        want = [tuple(text[i : i + least]) for i in range(len(text) - least + 1)]
        assert len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def covered(rows, doc):
    return {w for r in rows if r["doc"] == doc for w in range(r["first_word"], r["first_word"] + r["n_words"])}


def exact_repeats(texts, size):
    """Words of each document in a passage of ``size`` words that a smaller one has too, by brute force."""
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        mine = [tuple(w[j : j + size]) for j in range(len(w) - size + 1)]
        out[i] = {x for j, m in enumerate(mine) if m in seen for x in range(j, j + size)}
        seen |= set(mine)
    return out


def test_every_exact_passage_is_found_though_smaller_documents_quote_a_part(spark):
    r = random.Random(4)
    texts = [" ".join(words(1000 + i, 120, 10_000)) for i in range(100)]
    for p in range(12):
        passage = words(5000 + p, 60, 10_000)
        for doc, part in zip(r.sample(range(60), 3), (passage[:30], passage[15:45], passage[30:])):
            w = texts[doc].split()
            texts[doc] = " ".join(w[:50] + part + w[50:])
        for doc in r.sample(range(60, 100), 2):
            w = texts[doc].split()
            texts[doc] = " ".join(w[:70] + passage + w[70:])
    rows = substring_dedup.repeated_passages(table(spark, texts)).collect()
    for doc, want in exact_repeats(texts, 50).items():
        got = covered(rows, doc)
        assert want <= got and bool(want) == bool(got)
    for x in rows:
        assert x["of_doc"] < x["doc"]
        a, b = (shingles(" ".join(texts[d].split()[f : f + k]), 5) for d, f, k in ((x["doc"], x["first_word"], x["n_words"]), (x["of_doc"], x["of_first_word"], x["of_n_words"])))
        assert len(a & b) * 100 >= 80 * len(a | b) and abs(x["similarity"] - len(a & b) / len(a | b)) < 1e-9


def test_passages_of_repeated_ids_copies_long_texts_and_twice_in_one_document(spark):
    passage = " ".join(words(61, 60, 10_000))
    one, two, three = (" ".join(words(s, 200, 10_000)) for s in (71, 72, 73))
    long = " ".join(words(74, 60_000, 10_000))
    rows = [
        (1, one + " " + passage), (1, two), (2, passage + " " + three + " " + passage), (3, two), (3, two), (5, "a " * 400), (6, "a " * 300),
        (7, long + " " + passage), (7, None), (None, passage), (8, passage[:200]), (4, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as copy", "'x' as key", "2 as DOC")
    out = substring_dedup.repeated_passages(df).collect()
    assert {(x["doc"], x["first_word"], x["n_words"], x["of_doc"], x["of_n_words"]) for x in out if x["doc"] in (2, 3, 7)} == {(2, 0, 60, 1, 60), (2, 260, 60, 1, 60), (3, 0, 200, 1, 200), (7, 60_000, 60, 1, 60)}
    assert {x["doc"] for x in out} == {2, 3, 6, 7} and covered(out, 6) == set(range(300))


def alike_somewhere(a, b, size=50, n=5, percent=80):
    """Whether ``size`` words of both are alike, by brute force."""
    x, y = ([shingles(" ".join(w[i : i + size]), n) for i in range(len(w) - size + 1)] for w in (a.split(), b.split()))
    return any(100 * len(p & q) >= percent * len(p | q) for p in x for q in y if p & q)


def test_no_near_passage_is_lost_behind_a_smaller_document_with_the_same_seeds(spark):
    r = random.Random(9)
    texts = [words(3000 + i, 75, 10_000) for i in range(36)]
    for p in range(6):
        passage = words(7000 + p, 56, 10_000)
        # small documents quote parts that are too short, the others have the passage with a word changed
        for doc, part in zip((2 * p, 2 * p + 1), (passage[:30], passage[26:])):
            texts[doc][40:40] = part
        for i, doc in enumerate((12 + p, 18 + p, 24 + p, 30 + p)):
            near = list(passage)
            near[28] = f"changed{i}"
            # the last ones share 48 words, so a passage must take two others
            texts[doc][r.randrange(20, 60) : 60] = near if i < 2 else passage[:48]
    texts = [" ".join(w) for w in texts]
    rows = substring_dedup.repeated_passages(table(spark, texts)).collect()
    of = {}
    for x in rows:
        for d in (x["doc"], x["of_doc"]):
            of.setdefault(d, set()).add(x["class_doc"])
        assert x["class_doc"] <= x["of_doc"] < x["doc"] and x["similarity"] >= 0.8
    near = [(i, j) for j in range(36) for i in range(j) if alike_somewhere(texts[i], texts[j])]
    assert len(near) >= 12
    assert [(i, j) for i, j in near if not of.get(i, set()) & of.get(j, set())] == []


def test_seeds_of_a_shared_run_are_the_same():
    size, reach = substring_dedup.seed_sizes(46, 5, 80)
    assert substring_dedup.shared_run(46, 5, 80) == 21 and size + reach - 1 == 21
    r = np.random.default_rng(6)
    run = r.integers(1, 2**60, 21).astype(np.uint64)
    for _ in range(50):
        texts = [np.concatenate([r.integers(1, 2**60, r.integers(0, 60)).astype(np.uint64), run, r.integers(1, 2**60, 40).astype(np.uint64)]) for _ in range(2)]
        key, which, _, place, _ = substring_dedup.compact_windows([substring_dedup.stretch_hashes(t, size) for t in texts], reach, 0)
        assert set(key[which == 0].tolist()) & set(key[which == 1].tolist())
        near = substring_dedup.around(texts, np.array([0, 1]), np.array([len(t) - 61 for t in texts]), np.array([len(t) - 41 for t in texts]))
        assert near[0] == near[1]


def test_line_pairs_are_confirmed_as_their_edit_distance_says():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r, rows = random.Random(5), []
    for n in [1, 2, 3, 7, 24, 40, 90, 150, 260] * 20:
        a = "".join(r.choice("abcdé ") for _ in range(n))
        cut = r.randrange(n)
        b = edited(r, a, r.randint(0, max(1, n // 4))) if r.random() < 0.7 else a[cut:] + a[:cut]
        rows.append((len(rows), a, b or "z"))
    pairs = pd.DataFrame([(k, k, a, b) for k, a, b in rows], columns=["a", "b", "form_a", "form_b"])
    apart = [distance(a, b) for _, a, b in rows]
    for percent in (80, 50):
        want = {k for (k, a, b), d in zip(rows, apart) if d <= max(len(a), len(b)) * (100 - percent) // 100}
        assert 0 < len(want) < len(rows)
        assert set(pd.concat(line_dedup._near_lines(percent)(iter([pairs])))["a"]) == want
    # letters differ in two bits an edit at most, so they let all pairs that link pass
    x, y = (line_dedup.letters([row[side] for row in rows]) for side in (1, 2))
    bits = sum(np.bitwise_count((x[c] ^ y[c]).view(np.uint64)).astype(int) for c in line_dedup.LETTERS)
    assert (bits <= 2 * np.array(apart)).all()
    assert line_dedup.within("a" * 500 + "b", "a" * 500 + "c", 1) and not line_dedup.within("abc", "xyz", 2)


def test_pivots_of_a_bucket_are_compared_in_one_round_without_a_join_by_key(spark):
    rows, asked = [(1, n, 0) for n in range(300)], []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where("a % 3 = b % 3")

    work = store.Workspace(spark, "test")
    members = work.stored(spark.createDataFrame(rows, "key long, node long, low long"), "members")
    group, _ = linking.linked_components(members, verify, work, pivots=3)
    assert {r["node"]: r["component"] for r in group.collect()} == {n: n % 3 for n in range(3, 300)}
    # the smallest, the pivots at once, the rest
    assert len(asked) <= 3 and max(asked) < 150 * 299


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_few_edges_are_found_in_one_partition(spark, few, monkeypatch):
    monkeypatch.setattr(linking, "FEW", few)
    steps, stars = [], linking._stars
    monkeypatch.setattr(linking, "_stars", lambda edges, one=lambda df: df: steps.append(stars(edges, one)) or steps[-1])
    work = store.Workspace(spark, "test")
    edges = spark.createDataFrame([(n, n + 1) for n in range(0, 40) if n % 10 != 9], "a long, b long")
    assert {r["node"]: r["component"] for r in linking.components(edges, work).collect()} == {n: n // 10 * 10 for n in range(40) if n % 10}
    assert steps and all(("Exchange hash" in s._jdf.queryExecution().executedPlan().toString()) == (few == 0) for s in steps)


def test_last_round_takes_turns_where_buckets_have_many_pairs(spark):
    rows, asked = [(key, 30 * key + n, 30 * key) for key in range(20) for n in range(30)], []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where("a % 3 = b % 3")

    work = store.Workspace(spark, "test")
    members = work.stored(spark.createDataFrame(rows, "key long, node long, low long"), "members")
    group, links = linking.linked_components(members, verify, work, pivots=0, pass_pairs=100)
    assert {r["node"]: r["component"] for r in group.collect()} == {n: n - n % 30 + n % 3 for n in range(600) if n % 30 >= 3}
    # 14.5 pairs a row, 4 a row in a pass; a pass asks for pairs of its own keys only
    assert len(asked) == 5 and sum(asked[1:]) > 2 * max(asked[1:]) and links.count() == links.distinct().count()


def test_line_keys_are_not_stored_beside_the_lines(spark, monkeypatch):
    tables, stored = {}, store.Workspace.stored
    monkeypatch.setattr(store.Workspace, "stored", lambda self, df, label: tables.setdefault(label, df.dtypes) and stored(self, df, label))
    texts = [" ".join(words(7, 30)), " ".join(words(7, 30)[:-1]) + " other"]
    assert [r["keep"] for r in line_dedup.repeated_lines(table(spark, texts), near="edit").orderBy("doc").collect()] == [True, False]
    assert dict(tables["lines"]) == {"doc": "bigint", "copy": "bigint", "line": "int", "node": "bigint"}


def test_edits_of_many_pairs_at_once_equal_those_of_each(spark):
    r, a, b = random.Random(6), [], []
    for n in [1, 2, 5, 63, 64, 65, 127, 128, 129, 300, 700] * 12:
        x = "".join(r.choice("abcé") for _ in range(n))
        a.append(x)
        b.append(edited(r, x, r.randint(0, n // 3)) if r.random() < 0.8 else "".join(r.choice("abcé") for _ in range(n)))
    a, b = a + ["", "abc", ""], b + ["abc", "", ""]
    codes = [np.zeros((len(a), max(map(len, side))), np.uint32) for side in (a, b)]
    for at, side in zip(codes, (a, b)):
        for k, x in enumerate(side):
            at[k, : len(x)] = [ord(c) for c in x]
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    con = duckdb.connect()
    far = np.array([con.execute("select levenshtein(?, ?)", [x.replace("é", "d"), y.replace("é", "d")]).fetchall()[0][0] for x, y in zip(a, b)])
    for most in (far, np.maximum(far - 1, 0), far + 3):
        assert (line_dedup.all_within(*codes, *sizes, most) == (far <= most)).all()
        assert [line_dedup.within(x, y, int(m)) for x, y, m in zip(a, b, most)] == (far <= most).tolist()


def test_only_pairs_with_enough_common_tokens_are_searched_for_passages(monkeypatch):
    r, n, least, percent = np.random.default_rng(3), 3, 10, 80
    texts, others = [], []
    for _ in range(600):
        # few different tokens: many repeat, some stretches not at all
        x = r.integers(0, r.integers(2, 90), r.integers(1, 60)).astype(np.uint64) * np.uint64(2**40 + 12345)
        cut = r.integers(0, len(x) + 1)
        y = np.concatenate([x[cut:], x[: r.integers(0, cut + 1)]])
        y[r.random(len(y)) < 0.1] = np.uint64(7)
        texts.append(x)
        others.append(y)
    found = [substring_dedup.every_passage(x, y, n, least, percent) for x, y in zip(texts, others)]
    may = substring_dedup.may_share(texts, others, least, percent)
    assert any(found) and not may.all() and all(m for m, f in zip(may, found) if f)
    for x, y, f in zip(texts, others, found):
        for first, last, there, end, alike in f:
            a, b = set(x[first : last + 1].tolist()), set(y[there : end + 1].tolist())
            assert alike == len(a & b) / len(a | b) >= 0.8 and last - first + 1 >= least <= end - there + 1
    rows = pd.DataFrame([(1, 0, 0, 9, 0, 0, 0, 9, y.tobytes(), x.tobytes()) for x, y in zip(texts, others)], columns=["a", "copy_a", "lo_a", "hi_a", "b", "copy_b", "lo_b", "hi_b", "tokens_a", "tokens_b"])
    searched, search = [], substring_dedup.every_passage
    monkeypatch.setattr(substring_dedup, "every_passage", lambda *args: searched.append(args) or search(*args))
    out = pd.concat(substring_dedup._verified(n, least, percent)(iter([rows])))
    assert len(searched) == may.sum() and len(out) == sum(map(len, found))


def test_tokens_of_many_spans_are_hashed_at_once(monkeypatch):
    n, texts = 5, [" ".join(words(i, i % 40)) for i in range(300)]
    spans = [(k, 0, lo, lo + 9) for k, t in enumerate(texts) for lo in range(0, len(t.split()), 7)]
    batch = pd.DataFrame([(k, 0, t, np.arange(0, len(t.split()), 7), np.arange(0, len(t.split()), 7) + 9) for k, t in enumerate(texts)], columns=["doc", "copy", "text", "los", "his"])
    hashes, calls, mix = ngram_jaccard.WordHashes(), [], substring_dedup.mixed
    expected = [substring_dedup.token_hashes(" ".join(texts[k].split()[lo : hi + n]), n, hashes).tobytes() for k, _, lo, hi in spans]
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: calls.append(1) or mix(x))
    out = pd.concat(substring_dedup._segments(n)(iter([batch])))
    assert list(out[["doc", "copy", "lo", "hi"]].itertuples(index=False, name=None)) == spans and out["tokens"].tolist() == expected
    assert sum(map(bool, expected)) > 500 and len(calls) <= (n + 1) * (1 + out["tokens"].str.len().sum() // 8 // 1000)


def test_stretches_without_repeats_are_compared_by_their_counts(monkeypatch):
    r, n, least, percent = np.random.default_rng(5), 3, 20, 80
    sets, made = [], substring_dedup.reduce
    monkeypatch.setattr(substring_dedup, "reduce", lambda *args: sets.append(1) or made(*args))
    found, compared = 0, 0
    for turn in range(200):
        a = r.permutation(90).astype(np.uint64)
        if turn % 2:
            a[r.integers(0, 90, 30)] = a[:30]
        b = a.copy()
        b[r.random(90) < 0.25] += np.uint64(1000)
        at = len(sets)
        out = substring_dedup.every_passage(a, b, n, least, percent)
        stretches = [x for x in out if x[1] - x[0] + 1 == least]
        for first, last, there, end, alike in out:
            x, y = set(a[first : last + 1].tolist()), set(b[there : end + 1].tolist())
            assert alike == len(x & y) / len(x | y) >= 0.8
        if turn % 2:
            compared += len(sets) - at
        else:
            assert len(sets) == at
            found += len(stretches)
    assert found and compared
    for i in range(200):
        x = r.integers(0, r.integers(2, 60), r.integers(1, 50))
        stretch = int(r.integers(1, 12))
        assert [len(set(x[k : k + stretch].tolist())) < len(x[k : k + stretch]) for k in range(len(x))] == substring_dedup._twice(x, stretch).tolist()


def test_spans_with_too_few_common_tokens_are_not_laid_over_each_other(monkeypatch):
    tried, alike = [], substring_dedup._alike
    monkeypatch.setattr(substring_dedup, "_alike", lambda *args: tried.append(1) or alike(*args))
    a = np.arange(120, dtype=np.uint64)
    b = a + np.uint64(1000)
    b[[*range(0, 120, 3), *range(50, 60)]] = a[[*range(0, 120, 3), *range(50, 60)]]
    assert substring_dedup.every_passage(a, b, 5, 46, 80) == [] and not tried
    b = a + np.uint64(1000)
    b[20:90] = a[20:90]
    assert substring_dedup.every_passage(a, b, 5, 46, 80) == [(20, 89, 20, 89, 1.0)] and tried


def test_texts_of_copies_are_split_into_words_once(spark, monkeypatch):
    text = " ".join(words(1, 80))
    docs = table(spark, [text, text, " ".join(words(2, 80)), " ".join(words(2, 80)), text + " z"])
    plans, written = [], store._written
    monkeypatch.setattr(store, "_written", lambda df, path: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, path))
    out = substring_dedup.repeated_passages(docs).collect()
    assert {(x.doc, x.of_doc, x.n_words) for x in out if x.doc < 4} == {(1, 0, 80), (3, 2, 80)}
    assert sum("split(text" in p for p in plans) == 1

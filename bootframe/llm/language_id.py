"""Language identification by interpolated Kneser-Ney character models.

One model a language over the letters of words: a word is read as ``^word$`` in lower case and
each letter (and the end) is predicted from up to ``order - 1`` characters before it. Counts of
n-grams are collected by Spark from a bounded sample of labelled documents; the model's
probabilities are kept in sorted arrays of n-gram hashes, with a column a language, and looked
up by binary search. A text's cross-entropy in a language is the mean over its letters; the
language with the lowest one is chosen. A part of the sample that doesn't enter the counts sets
how high a cross-entropy a text of the language may have (``rejected`` otherwise) and how
sharply differences turn into a score.

Words score alone, so each different word of a slice of texts is scored once. Broadcast: the
model, whose size is bounded by the sample (``SAMPLE_DOCS`` documents a language, of which
those over ``SAMPLE_CHARS`` characters aren't taken). Memory: a
slice of about a million characters, and its different words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import opened, shared

#: Labelled documents a language that the models are fitted on, about.
SAMPLE_DOCS = 1000
#: Longer documents aren't taken into the sample (they are predicted like any other).
SAMPLE_CHARS = 50_000
#: Words whose scores a task keeps at most.
WORDS_KEPT = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# how far above the calibrating texts a cross-entropy may be: standard deviations, share of the worst, share of the mean
_MARGIN_SDS, _MARGIN_SHARE, _MARGIN_MEAN = 8.0, 1.15, 2.0


def word_list(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    runs = _WORD.findall(text.lower()) if text else []
    if not runs or "".join(runs).isalpha():
        return runs
    # \w also has numbers that aren't digits (², ½, Ⅳ): they part words like digits
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


def gram_hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each predicted character of the words, n from 1 to
    ``order`` (0 where the word doesn't reach back so far), and each one's word number."""
    joined = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    number = np.repeat(np.arange(len(words)), lengths)
    predicted = np.flatnonzero(place > 0)
    out, h = [], np.zeros(len(predicted), np.uint64)
    for n in range(1, order + 1):
        reach = place[predicted] >= n - 1
        back = codes[np.maximum(predicted - (n - 1), 0)]
        h = (h ^ (back + np.uint64(n))) * _FACTOR
        h = h ^ (h >> np.uint64(31))
        out.append(np.where(reach, h | np.uint64(1), np.uint64(0)))
    return out, number[predicted]


def _gram_counts(order: int):
    """Count of each n-gram of the top order, and of the shorter ones at a word's start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"]):
                for w, n in Counter(word_list(text)).items():
                    w = f"^{w}$"
                    for end in range(2, len(w) + 1):
                        counts[lang, w[max(0, end - order) : end]] += n
            yield pd.DataFrame([(a, g, n) for (a, g), n in counts.items()], columns=["lang", "gram", "n"])

    return run


class KneserNey:
    """Probabilities of all languages in sorted hash arrays, one a length of n-gram."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int) -> None:
        self.langs, self.order = sorted(counts), order
        tables: list[dict[str, list]] = [{} for _ in range(order)]
        self.floor = []
        for at, lang in enumerate(self.langs):
            for n, grams in enumerate(self._probabilities(counts[lang], order)):
                for gram, (p, back) in grams.items():
                    row = tables[n].setdefault(gram, [None] * len(self.langs))
                    row[at] = (p, back)
        self._lookup_tables(tables)

    def _probabilities(self, top: dict[str, int], order: int) -> list[dict[str, tuple[float, float]]]:
        """For each length: gram to (interpolated log probability of its last character, log of
        the weight that its own context gives to shorter contexts)."""
        # counts of the top order and of grams that start a word; below, how many characters precede
        level: list[Counter] = [Counter() for _ in range(order)]
        for gram, n in top.items():
            level[len(gram) - 1][gram] += n
        for n in range(order - 1, 0, -1):
            for gram in level[n]:
                level[n - 1][gram[1:]] += 1
        out: list[dict[str, tuple[float, float]]] = []
        alphabet = len(level[0]) + 1
        lower: dict[str, float] = {}
        self.floor.append(math.log(0.1 / (0.1 * alphabet + sum(level[0].values()))))
        for n in range(order):
            ones, twos = sum(c == 1 for c in level[n].values()), sum(c == 2 for c in level[n].values())
            cut = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: Counter = Counter()
            kinds: Counter = Counter()
            for gram, c in level[n].items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            here: dict[str, float] = {}
            for gram, c in level[n].items():
                ctx = gram[:-1]
                if n:
                    here[gram] = max(c - cut, 0) / total[ctx] + cut * kinds[ctx] / total[ctx] * lower[gram[1:]]
                else:
                    here[gram] = (c + 0.1) / (total[ctx] + 0.1 * alphabet)
            if n:
                for ctx in total:  # the weight that the context leaves to shorter ones
                    p, _ = out[n - 1].get(ctx, (math.nan, 0.0))
                    out[n - 1][ctx] = (p, math.log(cut * kinds[ctx] / total[ctx]))
            out.append({g: (math.log(p), 0.0) for g, p in here.items()})
            lower = here
        return out

    def _lookup_tables(self, tables: list[dict[str, list]]) -> None:
        self.keys, self.logp, self.back = [], [], []
        for n, grams in enumerate(tables):
            keys = np.fromiter((self._key(g) for g in grams), np.uint64, len(grams))
            p = np.array([[math.nan if x is None else x[0] for x in row] for row in grams.values()], np.float32).reshape(-1, len(self.langs))
            b = np.array([[0.0 if x is None else x[1] for x in row] for row in grams.values()], np.float32).reshape(-1, len(self.langs))
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.logp.append(p[order])
            self.back.append(b[order])
        self.floor = np.array(self.floor, np.float32)

    @staticmethod
    def _key(gram: str) -> np.uint64:
        h = 0
        for n, ch in enumerate(reversed(gram), 1):
            h = ((h ^ (ord(ch) + n)) * int(_FACTOR)) % 2**64
            h ^= h >> 31
        return np.uint64(h | 1)

    def _find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys[n], hashes)
        at[at == len(self.keys[n])] = 0
        return at, self.keys[n][at] == hashes

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its predicted characters."""
        hashes, number = gram_hashes(words, self.order)
        total = np.repeat(self.floor[None, :], len(number), axis=0)
        for n in range(self.order):
            # a longer gram that a language knows replaces the shorter one's value; else its context's weight comes on top
            if n:
                ctx = self._context(hashes, number, n)
                at, hit = self._find(n - 1, ctx)
                total += np.where(hit[:, None], self.back[n - 1][at], 0)
            at, hit = self._find(n, hashes[n])
            p = np.where(hit[:, None], self.logp[n][at], np.nan)
            total = np.where(np.isnan(p), total, p)
        sums = np.add.reduceat(total, np.flatnonzero(np.diff(number, prepend=-1)), axis=0, dtype=np.float64)
        return sums, np.bincount(number, minlength=len(words))

    def _context(self, hashes: list[np.ndarray], number: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n characters before each predicted one (0: the word doesn't reach back so far)."""
        before = np.concatenate([[np.uint64(0)], hashes[n - 1][:-1]])
        first = np.concatenate([[True], number[1:] != number[:-1]])
        start = np.full(1, self._key("^"), np.uint64)[0] if n == 1 else np.uint64(0)
        return np.where(first, start, before)


class WordScores:
    """Scores of the words met so far; emptied when it holds ``WORDS_KEPT`` words."""

    def __init__(self, model: KneserNey) -> None:
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.sums, self.chars = np.empty((0, len(self.model.langs))), np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        fresh = [w for w in words if w not in self.at]
        if len(self.at) + len(fresh) > WORDS_KEPT:
            self._empty()
            fresh = words
        if fresh:
            sums, chars = self.model.word_scores(fresh)
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
            self.sums, self.chars = np.concatenate([self.sums, sums]), np.concatenate([self.chars, chars])

    def texts(self, texts: list[str | None], slice_chars: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a letter) of each text in each language, and its letters counted;
        texts without a letter count 0."""
        entropy, letters = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            words: list[list[str]] = []
            size = 0
            while at + len(words) < len(texts) and (size < slice_chars or not words):
                text = texts[at + len(words)]
                words.append(word_list(text))
                size += len(text or "")
            self.learn(list(dict.fromkeys(w for ws in words for w in ws)))
            for i, ws in enumerate(words, at):
                if ws:
                    index = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
                    letters[i] = n = self.chars[index].sum()
                    entropy[i] = -self.sums[index].sum(axis=0) / n
            at += len(words)
        return entropy, letters


class Identifier:
    """A fitted model with its calibration."""

    def __init__(self, model: KneserNey, most: np.ndarray, sharpness: float) -> None:
        self.model, self.most, self.sharpness = model, most, sharpness

    def __call__(self, texts: list[str | None], known: WordScores) -> pd.DataFrame:
        entropy, letters = known.texts(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        gap = (entropy - lowest[:, None]) * self.sharpness * np.sqrt(np.maximum(letters, 1))[:, None]
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        none = letters == 0
        # the mean over few letters strays further
        rejected = none | (lowest > self.most[best] * (1 + 2 / np.sqrt(np.maximum(letters, 1))))
        return pd.DataFrame({"lang_pred": np.where(none, "und", np.array(self.model.langs, object)[best]), "score": np.where(none, 0.0, score), "entropy": np.where(none, np.nan, lowest), "rejected": rejected})


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids: null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(labelled: DataFrame, order: int = 5, docs: int = SAMPLE_DOCS) -> Identifier | None:
    """Fit models on a sample of ``labelled`` (doc_id, text, lang; rows with a null in either
    are left out): of each language about ``docs`` documents, chosen by a hash of the id.
    An eighth of it calibrates. No labelled row with a letter: None."""
    rows = labelled.where("doc_id is not null and text is not null and lang is not null and length(text) <= %d" % SAMPLE_CHARS)
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    luck = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0
    share = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, docs / n))])
    sample = rows.select("doc_id", "text", "lang").where(luck < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(8)) == 0
    few = sample.where(~aside).select("lang", "text").mapInPandas(_gram_counts(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in few.toPandas().itertuples():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    if not counts:
        return None
    model = KneserNey(counts, order)
    sent = shared(labelled.sparkSession, model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = opened(sent)
        known = WordScores(model)
        for batch in batches:
            entropy, letters = known.texts(list(batch["text"]))
            own = np.array([model.langs.index(x) if x in model.langs else -1 for x in batch["lang"]])
            keep = (own >= 0) & (letters > 0)
            entropy, letters, own = entropy[keep], letters[keep], own[keep]
            mine = entropy[np.arange(len(own)), own]
            rest = entropy.copy()
            rest[np.arange(len(own)), own] = np.inf
            gap = (rest.min(axis=1) - mine) * np.sqrt(letters)
            yield pd.DataFrame({"own": own, "entropy": mine, "gap": gap})

    seen = sample.where(aside).select("lang", "text").mapInPandas(measured, "own int, entropy double, gap double")
    by = {r["own"]: r for r in seen.groupBy("own").agg(F.avg("entropy").alias("mean"), F.max("entropy").alias("worst"), F.coalesce(F.stddev_pop("entropy"), F.lit(0.0)).alias("sd"), F.expr("percentile_approx(least(gap, 1e6), 0.02, 1000)").alias("gap")).collect()}
    most = np.full(len(model.langs), np.inf)
    for i, r in by.items():
        most[i] = max(r["mean"] + _MARGIN_SDS * r["sd"], r["worst"] * _MARGIN_SHARE, r["mean"] * _MARGIN_MEAN)
    # the closest calls of the sample score about 0.95
    gaps = [r["gap"] for r in by.values() if r["gap"] > 0]
    return Identifier(model, most, math.log(19) / max(min(gaps, default=1.0), 1e-3))


def identify(docs: DataFrame, model: Identifier | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred (a language of the model; ``und`` for texts that are null or
    without a letter, or if there is no model), score (0 to 1; 0 for ``und``), entropy (nats a letter;
    null for ``und``) and rejected (``und``, or a cross-entropy that no text of the language should have).

    Only the text enters. Rows that repeat get equal predictions. Columns of the input pass
    through; those with one of the four new names are replaced.
    """
    new = "lang_pred string, score double, entropy double, rejected boolean"
    fresh = {"lang_pred", "score", "entropy", "rejected"}
    kept = [c for c in docs.columns if c.lower() not in fresh]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    sent = shared(docs.sparkSession, model)

    @F.pandas_udf(new)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = opened(sent)
        known = WordScores(model.model)
        for texts in batches:
            yield model(list(texts), known)

    met = docs.withColumn("__p", predicted(F.col(text_col).cast("string")))
    return met.select(*[F.col(f"`{c}`") for c in kept], F.col("__p.lang_pred"), F.col("__p.score"), F.when(~F.isnan("__p.entropy"), F.col("__p.entropy")).alias("entropy"), F.col("__p.rejected"))

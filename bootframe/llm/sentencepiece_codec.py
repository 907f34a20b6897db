"""SentencePiece encoding and decoding by tables of distinct marked words.

SentencePiece turns spaces into marks (U+2581) and puts one in front. Where no piece of the
vocabulary holds a mark behind another character, no merge crosses the place before a run of
marks, so a text's pieces are those of its marked words (a run of marks with the characters up
to the next mark) one after the other. Each different marked word of a task is segmented once,
and its ids, and the text they decode to, are joined back by position.

The table of marked words belongs to a task, not to the whole corpus: a global table would
move every word occurrence, or every task's vocabulary twice, through a shuffle, several times
the size of the input (figures in the README). So encoding needs no shuffle, and a task's
memory is bounded by ``WORDS_KEPT`` marked words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marked words that a task's table holds at most.
WORDS_KEPT = 150_000
MARK = "▁"

_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


_LOADED: dict[str, bytes] = {}


def _processor(model: str) -> spm.SentencePieceProcessor:
    """A processor of the model file, which a Python worker reads once."""
    if model not in _LOADED:
        with open(model, "rb") as f:
            _LOADED[model] = f.read()
    return spm.SentencePieceProcessor(model_proto=_LOADED[model])


def words_are_separate(sp: spm.SentencePieceProcessor) -> bool:
    """Whether marked words segment on their own: the mark is a piece, no piece has a mark behind
    another character, and the normaliser only marks spaces (it changes none of a few probes, keeps runs of
    spaces, and puts one mark in front)."""
    if sp.piece_to_id(MARK) == sp.unk_id() or any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.vocab_size()) if not sp.is_control(i)):
        return False
    probes = ["a  b", " a", "a ", "éﬁＡ ①­​", "a\tb\nc d　e", "é 가"]
    return all(sp.normalize(x) == MARK + x.replace(" ", MARK) for x in probes)


class WordTable:
    """Marked words to their ids, the same as decimal text, and the text that the ids decode to
    behind another word, for one task."""

    def __init__(self, model: str) -> None:
        self.sp = _processor(model)
        self.separate = words_are_separate(self.sp)
        self.decimal = [str(i) for i in range(self.sp.vocab_size())]
        self.known: dict[str, tuple[list[int], str, str]] = {}
        # ids of a word to decode others behind
        self.anchor = self.sp.encode("a")

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
            fresh = list(words)
        # the library puts one mark in front by itself, but not before an empty text
        found = [ids if w != MARK else [self.sp.piece_to_id(MARK)] for w, ids in zip(fresh, self.sp.encode([w[1:] for w in fresh], num_threads=1))]
        for w, ids, text in zip(fresh, found, self.sp.decode([self.anchor + ids for ids in found], num_threads=1)):
            self.known[w] = ids, " ".join([self.decimal[i] for i in ids]), text[1:]

    def met(self, texts: list[str]) -> list[list[tuple[list[int], str, str]]]:
        """The entries of each text's marked words, in order."""
        split = [_MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return [[self.known[w] for w in ws] for ws in split]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if not self.separate:
            return self.sp.encode(texts, num_threads=1)
        return [list(chain.from_iterable([m[0] for m in entries])) for entries in self.met(texts)]

    def round_trips(self, texts: list[str], end: int) -> Iterator[tuple[Callable[[], list[int]], int, str, str]]:
        """Of each text: a function that gives its ids, their number, the ids as text with spaces
        between, the text they decode to; ``end`` comes last."""
        if not self.separate:
            for ids in self.sp.encode(texts, num_threads=1):
                ids = [*ids, end]
                yield lambda ids=ids: ids, len(ids), " ".join(map(str, ids)), self.sp.decode(ids)
            return
        for entries in self.met(texts):
            # the space of the mark in front of a text goes when it is decoded
            decimal = " ".join([*[m[1] for m in entries], str(end)])
            yield lambda e=entries: [*chain.from_iterable([m[0] for m in e]), end], decimal.count(" ") + 1, decimal, "".join([m[2] for m in entries])[1:]


def _slices(texts: list[str | None], chars: int) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _mapped(docs: DataFrame, column: str, replaced: list[str], run: Callable, types: list[str]) -> DataFrame:
    """``docs`` with the columns ``replaced`` of the given types: what ``run()`` makes of
    ``column``, a slice at a time. Other columns travel under names that can't clash."""
    kept = [c for c in docs.columns if c.lower() not in {r.lower() for r in replaced}]
    at, new = [f"__c{i}" for i in range(len(kept))], [f"__n{i}" for i in range(len(replaced))]
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(kept, at)], F.col(f"`{column}`").alias("__value"))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = run()
        for batch in batches:
            done = 0
            for columns in step(list(batch["__value"])):
                rows = batch[at].iloc[done : done + len(columns[0])]
                done += len(rows)
                yield rows.assign(**{n: pd.Series(c, index=rows.index, dtype=object) for n, c in zip(new, columns)})

    made = plain.mapInPandas(mapped, ", ".join([*[f"{a} {docs.schema[c].dataType.simpleString()}" for a, c in zip(at, kept)], *[f"{n} {t}" for n, t in zip(new, types)]]))
    return made.select(*[F.col(a).alias(c) for a, c in zip(at + new, kept + replaced)])


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", end: bool = True) -> DataFrame:
    """``docs`` with ``ids_col``, the array of ids of the whole text as the library's ``encode``
    gives them (``end``: and the end id). A null text counts as empty. Other columns pass
    through; one named ``ids_col`` is replaced. ``model`` is a path that every executor has."""

    def run():
        table = WordTable(model)
        tail = [table.sp.eos_id()] if end else []
        return lambda texts: ([[ids + tail for ids in table.ids(part)]] for part in _slices(texts, 500_000))

    return _mapped(docs, text_col, [ids_col], run, ["array<int>"])


def decode(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``, the library's ``decode`` of the ids (null ids: empty). Other
    columns pass through; one named ``text_col`` is replaced."""

    def run():
        sp = _processor(model)
        text = lambda ids: sp.decode([int(i) for i in ids]) if ids is not None and len(ids) else ""
        return lambda rows: ([[text(ids) for ids in rows[a : a + 200]]] for a in range(0, len(rows), 200))

    return _mapped(docs, ids_col, [text_col], run, ["string"])


def round_trip(docs: DataFrame, model: str, text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """Encode (with an end id) and decode whole texts in one pass: ``docs`` with ``ids_col`` if
    named, n_tokens, ids_sha256 (decimal ids with one space between) and decoded_sha256. Same
    cases as :func:`encode`. Unless asked for, the ids never leave the task."""

    def run():
        table = WordTable(model)
        end = table.sp.eos_id()

        def step(texts: list[str | None]) -> Iterator[list[list]]:
            for part in _slices(texts, 500_000):
                out: list[list] = [[], [], [], []]
                for ids, n, decimal, decoded in table.round_trips(part, end):
                    row = (ids() if ids_col else None, n, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                    for column, value in zip(out, row):
                        column.append(value)
                yield out if ids_col else out[1:]

        return step

    names, types = [ids_col, "n_tokens", "ids_sha256", "decoded_sha256"], ["array<int>", "long", "string", "string"]
    return _mapped(docs, text_col, names if ids_col else names[1:], run, types if ids_col else types[1:])

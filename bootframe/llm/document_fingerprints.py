"""Order MinHash fingerprints of documents, sensitive to edit distance.

The k-mers of a text (k code points) are numbered by occurrence, so repeats differ. Each of
``m`` hash functions selects the ``l`` numbered k-mers with the smallest values; they are put
back in text order and the tuple is hashed to 32 bits. Two texts agree on a component when the
same k-mers are smallest in both and come in the same order, so moving text costs likeness as
replacing it does. The likeness of two fingerprints is the share of components that agree.

The functions are multiply-xor hashes of 32-bit k-mer hashes (documented approximation to
random permutations; ties go to the place that comes first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_jaccard import mixed

#: Values of all functions that are held at once (a longer text takes fewer functions at a time).
VALUES_HELD = 4_000_000
#: Documents of a range of ids, about.
RANGE_ROWS = 2_000


class OrderMinHash:
    """Fingerprints with ``m`` components of the ``l`` smallest numbered ``k``-mers."""

    def __init__(self, k: int = 8, l: int = 2, m: int = 32) -> None:  # noqa: E741
        if min(k, l, m) < 1:
            raise ValueError("k, l and m are positive")
        self.k, self.l, self.m = k, l, m
        draw = np.array([xxhash.xxh3_64_intdigest(b"omh", i) for i in range(m)], np.uint64)
        self.flip = (draw >> np.uint64(32)).astype(np.uint32)[:, None]
        self.factor = (draw.astype(np.uint32) | np.uint32(1))[:, None]

    def numbered(self, text: str) -> np.ndarray:
        """64-bit hashes of the k-mers in text order, each with its occurrence number. A text
        shorter than k is one k-mer, the empty text too."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = min(self.k, len(codes))
        h = np.full(len(codes) - width + 1, width, np.uint64)
        for i in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)]
        ordered = np.sort(h)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        number = np.zeros(len(h), np.uint64)
        if len(again):
            again = np.unique(again)
            at = np.searchsorted(again, h)
            at[at == len(again)] = 0
            places = np.flatnonzero(again[at] == h)
            by = np.argsort(at[places], kind="stable")
            group = at[places][by]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            number[places[by]] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        return mixed(h + number * np.uint64(0xD1342543DE82EF95))

    def __call__(self, text: str) -> np.ndarray:
        """The fingerprint's ``m`` components (uint32)."""
        mers = self.numbered(text)
        low = (mers >> np.uint64(32)).astype(np.uint32)[None, :]
        out = np.empty(self.m, np.uint32)
        step = max(1, VALUES_HELD // len(mers))
        for a in range(0, self.m, step):
            values = (low ^ self.flip[a : a + step]) * self.factor[a : a + step]
            rows = np.arange(len(values))
            picked = []
            for _ in range(min(self.l, len(mers))):
                at = values.argmin(axis=1)
                values[rows, at] = 2**32 - 1
                picked.append(at)
            total = np.zeros(len(values), np.uint64)
            for at in np.sort(np.array(picked), axis=0):
                total = mixed(total ^ mers[at])
            out[a : a + step] = (total >> np.uint64(32)).astype(np.uint32)
        return out


def as_text(components: np.ndarray) -> str:
    """Eight hex digits a component."""
    return components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", k: int = 8, l: int = 2, m: int = 32) -> DataFrame:  # noqa: E741
    """``docs`` with ``out_col``, the fingerprint of the whole text in hex (null: of the empty
    text). Equal texts have equal fingerprints. Other columns pass through; one named
    ``out_col`` is replaced."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        omh = OrderMinHash(k, l, m)
        for texts in batches:
            yield pd.Series([as_text(omh(t or "")) for t in texts], dtype=object)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()]
    return docs.select(*kept, run(F.col(f"`{text_col}`").cast("string")).alias(out_col))


def _compared(k: int, l: int, m: int):  # noqa: E741
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omh = OrderMinHash(k, l, m)
        held: tuple | None = None  # the row that waits for its next
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                text = r.text or ""
                own = omh(text)
                if held is not None and held[0] == r.range_id:
                    _, doc, before, print_ = held
                    cut = len(before) // 3
                    edited = before[: len(before) - cut] + text[:cut]
                    changed = omh(edited) if cut else print_
                    out.append((doc, len(before), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), as_text(print_), as_text(changed), likeness(print_, changed), likeness(print_, own)))
                held = None if r.guest else (r.range_id, r.doc, text, own)
            frame = pd.DataFrame(out, columns=["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.astype({"doc": "Int64"})

    return run


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, l: int = 2, m: int = 32) -> DataFrame:  # noqa: E741
    """Fingerprints of each text, of the text with its last third replaced by the start of the
    next document, and their likenesses.

    Next is by descending id (null ids last), after the last the first; rows that repeat an
    id follow by a hash of their text. Texts move once, into ranges of ids; each range also
    gets the first row of the range that follows, so no task waits for another. Null texts are
    empty. A table of one row is its own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    n = rows.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    cuts = sorted({int(c) for c in rows.select(F.col("place").cast("double").alias("p")).approxQuantile("p", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []

    @F.pandas_udf("int")
    def range_of(places: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(np.array(cuts, np.int64), places.to_numpy(np.int64)), dtype="int32")

    rows = rows.withColumn("range_id", range_of("place"))
    # the first row of each range: as many small rows as ranges
    heads = rows.groupBy("range_id").agg(F.min(F.struct((-F.col("place").cast("decimal(20,0)")).alias("minus"), F.col("tie"))).alias("h")).orderBy("range_id").collect()
    firsts = [(int(-h["h"]["minus"]), h["h"]["tie"], heads[i - 1]["range_id"]) for i, h in enumerate(heads)]
    guests = spark.createDataFrame(firsts, "place long, tie long, to int")
    guest = rows.join(F.broadcast(guests), ["place", "tie"]).dropDuplicates(["place", "tie", "to"]).select("doc", "text", "place", "tie", F.col("to").alias("range_id"), F.lit(True).alias("guest"))
    dealt = rows.select("doc", "text", "place", "tie", "range_id", F.lit(False).alias("guest")).unionAll(guest)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 8)
    dealt = dealt.repartition(parts, "range_id").sortWithinPartitions("range_id", "guest", F.desc("place"), "tie")
    out = dealt.select("doc", "text", "range_id", "guest").mapInPandas(_compared(k, l, m), "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc", id_col)

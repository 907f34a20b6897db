"""N-gram Jaccard join by PartEnum signatures.

A document's set holds 64-bit hashes of its distinct word n-grams. Two documents link when
``100 * intersection >= percent * union``. Sizes are cut into bands so narrow that two linked
sets are in the same band or in neighbouring ones. For each pair of neighbouring bands the
Hamming distance of two linked sets is at most ``k``. The hash domain is cut into equal parts, and each
part into ``left_out + 2`` smaller ones. At most ``k // (left_out + 1)`` parts hold more than ``left_out``
of the differing items; with a part more than that, linked sets agree in one part on all but ``left_out``
of its smaller parts. Each subset of that size gives a signature, a hash of its items (``left_out`` 0: whole parts).
Sets of equal content are one class and take part once; pairs that share a signature are verified
on the whole sets, see :mod:`.linking`. Before that, two exact lower bounds of the distance drop
pairs that can't link: the bits in which the sets' parities differ, and their counts by range.

Hashes of n-grams and of whole sets have 64 bits; sets whose hashes agree count as equal.
Broadcast: a bitmap of 4 MB. Memory: one document's set, or two when verifying, and one table of word
hashes a task, emptied at ``WORDS_KEPT`` words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import components, linked_components, shared_buckets
from .store import Workspace, sieve, sifted, stored

#: Words whose hashes a task keeps at most.
WORDS_KEPT = 200_000


# plain dicts, not lru_cache: a wrapper is pickled by name, which workers without the package can't load
_ODD: dict[int, np.uint64] = {}
_PARTS: dict[tuple[int, int, int, int], tuple[int, int]] = {}


def _odd(seed: int) -> np.uint64:
    if seed not in _ODD:
        _ODD[seed] = np.uint64(xxhash.xxh3_64_intdigest(b"odd", seed) | 1)
    return _ODD[seed]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: multiply and shift until each input bit moves each output bit."""
    for seed in (11, 12):
        x = (x ^ (x >> np.uint64(32))) * _odd(seed)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, computed on first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of ``text``: ASCII case folded, words
    cut at ASCII white space; fewer than ``n`` words: the whole sequence is the one n-gram;
    no word or null: empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total += mixed(h[i : i + len(total)] + _odd(100 + i)) * _odd(200 + i)
    return np.unique(mixed(total + np.uint64(width)))


def bands(limit: int, percent: int) -> list[tuple[int, int]]:
    """Size bands (low, high) up to one that holds ``limit``: sizes that can link differ by one band at most."""
    out, low = [], 1
    while low <= limit:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def parts_and_spare(smallest: int, sizes: int, percent: int, left_out: int = 0) -> tuple[int, int]:
    """Parts of an instance, and in how many of them a set may have an empty subset without a signature.

    Sets of the instance have ``smallest`` items or more, two of them ``sizes`` at most. Linked
    ones differ in at most ``most`` items, so of ``most // (left_out + 1) + 1 + spare`` parts
    ``spare + 1`` hold at most ``left_out`` of these: a set with an empty subset in at most ``spare`` parts
    still agrees on one that isn't empty, and needs no signature for the empty ones, which many
    sets would share by chance.
    """
    # distance = (1 - J) union and |a| + |b| = (1 + J) union, so distance <= (1 - J) / (1 + J) (|a| + |b|)
    least = (100 - percent) * sizes // (100 + percent) // (left_out + 1) + 1
    smaller = smaller_parts(left_out)
    for spare in range(least + 1):
        parts = least + spare
        empty = parts * min(1.0, math.comb(smaller, left_out) * math.exp(-smallest / (parts * smaller) * (smaller - left_out)))
        if empty + 3 * math.sqrt(empty) <= spare + 0.05:
            return parts, spare
    return least, 0


def smaller_parts(left_out: int) -> int:
    """Into how many smaller parts a part is cut."""
    return left_out + 2 if left_out else 1


class Signer:
    """Signatures of a set; the bands are extended as larger sets come."""

    def __init__(self, percent: int, left_out: int = 0) -> None:
        self.percent, self.left_out, self.bands = percent, left_out, bands(1000, percent)
        self.smaller = smaller_parts(left_out)
        self.subsets = list(combinations(range(self.smaller), self.smaller - left_out))
        self.highs = [high for _, high in self.bands]

    def parts(self, smallest: int, sizes: int) -> tuple[int, int]:
        key = (smallest, sizes, self.percent, self.left_out)
        if key not in _PARTS:
            _PARTS[key] = parts_and_spare(*key)
        return _PARTS[key]

    def __call__(self, items: np.ndarray) -> np.ndarray:
        n = len(items)
        if not n:
            return np.empty(0, np.int64)
        if self.highs[-2] < n:
            self.bands = bands(4 * n, self.percent)
            self.highs = [high for _, high in self.bands]
        band = int(np.searchsorted(self.highs, n))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(items + _odd(1)), dtype=np.uint64)])
        out = []
        for instance in (band, band + 1):
            # pairs within a band meet in their upper instance, so an instance needs its two bands' highest sizes
            below = self.bands[max(instance - 1, 0)]
            sizes = self.highs[instance] + (below[1] if instance else 0)
            parts, spare = self.parts(below[0], sizes)
            cells = parts * self.smaller
            cuts = (np.arange(1, cells, dtype=np.float64) * (2.0**64 / cells)).astype(np.uint64)
            ends = np.concatenate([[0], np.searchsorted(items, cuts), [n]])
            held = (sums[ends[1:]] - sums[ends[:-1]]).reshape(parts, self.smaller)
            counts = (ends[1:] - ends[:-1]).reshape(parts, self.smaller)
            total = np.stack([held[:, s].sum(axis=1) for s in self.subsets], axis=1)
            filled = np.stack([counts[:, s].sum(axis=1) for s in self.subsets], axis=1) > 0
            tag = np.uint64((instance << 32) & (2**64 - 1)) + np.arange(total.size, dtype=np.uint64).reshape(total.shape)
            signed = mixed(total ^ mixed(tag + _odd(2)))
            out.append(signed[filled] if parts - filled.all(axis=1).sum() <= spare else signed.ravel())
        return np.concatenate(out).view(np.int64)


def class_key(items: np.ndarray) -> int:
    """64-bit id of a set."""
    return xxhash.xxh3_64_intdigest(items.tobytes(), 7) - 2**63


def _features(n: int, percent: int, left_out: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sign = WordHashes(), Signer(percent, left_out)
        signed: set[int] = set()
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), max(1, len(batch) // 500)):
                rows = batch.iloc[part]
                sets = [ngram_set(t, n, hashes) for t in rows["text"]]
                keys = [class_key(s) for s in sets]
                signatures = []
                for doc, s, key in zip(rows["doc"], sets, keys):
                    # equal sets of a task are signed once
                    fresh = len(s) and not pd.isna(doc) and key not in signed
                    signatures.append(sign(s) if fresh else None)
                    if fresh:
                        if len(signed) >= WORDS_KEPT:
                            signed.clear()
                        signed.add(key)
                yield pd.DataFrame({"doc": rows["doc"].array, "n_shingles": [len(s) for s in sets], "node": keys, "sketch": [sketch(x) for x in sets], "signatures": signatures, **parities(sets)})

    return run


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), max(1, len(batch) // 500)):
                rows = batch.iloc[part]
                sets = [ngram_set(t, n, hashes) for t in rows["text"]]
                yield pd.DataFrame({"node": [class_key(s) for s in sets], "items": [s.tobytes() for s in sets]})

    return run


def sketch(items: np.ndarray) -> bytes:
    """How many items fall into each of 256 equal ranges of hashes (255 at most)."""
    return np.minimum(np.bincount((items >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


#: Columns of a set's parities, 64 bits each.
PARITIES = [f"parity_{i}" for i in range(8)]


def parities(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """For each of 512 residues of hashes, whether the number of items with it is odd. An item that only
    one of two sets has changes one bit, so the bits that differ are no more than the items that do."""
    places = [(s & np.uint64(511)).astype(np.int64) + 512 * i for i, s in enumerate(sets)]
    odd = np.bincount(np.concatenate([*places, np.empty(0, np.int64)]), minlength=512 * len(sets)).reshape(-1, 512) & 1
    words = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64).reshape(-1, len(PARITIES))
    return {c: words[:, i] for i, c in enumerate(PARITIES)}


def may_link(left: str, right: str, percent: int) -> Column:
    """Whether sizes and parities of two structs let their sets link."""
    m, n = F.col(f"{left}.size"), F.col(f"{right}.size")
    differ = sum((F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in PARITIES), F.lit(0))
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (differ * (100 + percent) <= (m + n) * (100 - percent))


def _may_link(percent: int):
    """Drops pairs that can't link: differences of the sketches add up to no more than the distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, 256).astype(np.int16) for c in ("sketch_a", "sketch_b"))
                m, n = batch["size_a"].to_numpy(), batch["size_b"].to_numpy()
                apart = np.abs(x - y).sum(axis=1)
                keep = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (apart * (100 + percent) <= (100 - percent) * (m + n))
                yield batch.loc[keep, ["a", "b"]]

    return run


def _overlaps(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["items_a"], batch["items_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    return run


def sharing_pairs(members: DataFrame, sizes: DataFrame, percent: int, slice_rows: int = 500) -> DataFrame:
    """All distinct pairs (a, b), a < b, of nodes that share a key and whose sizes allow a link.

    A key of many nodes is cut into slices: a node meets each slice in a row of its own, so its
    pairs are made in as many places as it has slices.
    """
    slices = members.groupBy("key").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
    at = members.select("key", "node").join(slices, "key").join(sizes.select("node", "size"), "node")
    left = at.select("key", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), F.col("node").alias("a"), F.col("size").alias("size_a"))
    right = at.select("key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("node").alias("b"), F.col("size").alias("size_b"))
    fit = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    return left.join(right, ["key", "slice"]).where("a < b").where(fit).select("a", "b").distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, count_links: bool = False, left_out: int = 1) -> DataFrame:
    """Groups of documents whose n-gram sets are linked by Jaccard similarity.

    Returns one row per input row: ``id_col``, n_shingles (size of its set), component_id
    (smallest id reachable by links, its own included), with ``count_links`` also n_links (how
    many different sets link with its own: every pair that shares a signature is verified then,
    where components alone spare most pairs of large groups). ``left_out``: smaller parts that a
    signature leaves out of each part; more of them make rarer and more signatures, the same groups.

    Rows with a null id take no part (component null, their set size is still given). Null
    or wordless texts have an empty set and are linked with nothing. Rows that repeat an id
    are one document: what links either links both. Other columns are ignored, so their
    names don't matter. An empty table gives an empty result.
    """
    if left_out < 0:
        raise ValueError("left_out is at least 0")
    spark = docs.sparkSession
    work = Workspace(spark, "ngrams")
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = work.stored(base.mapInPandas(_features(n, percent, left_out), "doc long, n_shingles long, node long, sketch binary, signatures array<long>, " + ", ".join(f"{c} long" for c in PARITIES)), "sets")
    known = found.where("doc is not null and n_shingles > 0").select("doc", "node")
    keyed = found.where("signatures is not null").select(F.explode("signatures").alias("key"), "node")
    members = work.stored(shared_buckets(keyed), "members")
    work.release()
    # of classes that share a signature: size, sketch and one document that has the set
    nodes = members.select("node").distinct()
    short = found.where("doc is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), *[F.first(c).alias(c) for c in PARITIES])
    short = work.stored(short, "sketches")

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (short.select(*[F.col(c).alias(d) for c, d in (("node", s), ("size", f"size_{s}"), ("sketch", f"sketch_{s}"))]) for s in "ab")
        close = work.stored(pairs.join(left, "a").join(right, "b").mapInPandas(_may_link(percent), "a long, b long"), "close")
        # whole sets only of what may link (an id with several texts brings sets that nobody asked for, too)
        asked = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        docs_asked = work.stored(short.join(asked, "node", "left_semi").select("doc").distinct(), "asked")
        few = sifted(base, F.col("doc"), sieve(docs_asked, "doc")).where("__in").drop("__in").join(docs_asked, "doc", "left_semi")
        sets = work.stored(few.mapInPandas(_sets(n), "node long, items binary").join(asked, "node", "left_semi").dropDuplicates(["node"]), "items")
        left, right = (sets.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}")) for s in "ab")
        return close.join(left, "a").join(right, "b").mapInPandas(_overlaps(percent), "a long, b long")

    if count_links:
        links = work.stored(verify(work.stored(sharing_pairs(members, short, percent), "pairs")), "links")
        group = components(links, work)
    else:
        marks = short.select("node", F.struct("size", *PARITIES).alias("mark"))
        group, links = linked_components(members, verify, work, marks=marks, fits=lambda a, b: may_link(a, b, percent))
    # an id with several sets joins their classes; then classes to the smallest id of their group
    several = known.groupBy("doc").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc", "lo")
    extra = known.join(several, "doc").where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    if extra.take(1):
        group = components(group.select(F.col("component").alias("a"), F.col("node").alias("b")).unionAll(extra), work)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = known.groupBy("node").agg(F.min("doc").alias("first")).join(group, "node", "left").select("node", "first", F.coalesce("component", "node").alias("part"))
    named = classes.join(classes.groupBy("part").agg(F.min("first").alias("component_id")), "part").join(degree, "node", "left").select("node", "component_id", "n_links")
    out = found.select("doc", "n_shingles", F.when(F.expr("doc is not null and n_shingles > 0"), F.col("node")).alias("node")).join(named, "node", "left")
    counted = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if count_links else []
    out = out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"), *counted)
    out = stored(out, "ngram-groups")
    work.close()
    return out


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80, left_out: int = 1) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one document of each group left:
    the one with the smallest doc_id. Rows that repeat a doc_id or have none all stay or all go."""
    gone = jaccard_groups(docs, n=n, percent=percent, left_out=left_out).where("component_id < doc_id").select("doc_id").distinct()
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = sifted(docs.toDF(*names), F.col(names[docs.columns.index("doc_id")]).cast("long"), sieve(gone, "doc_id"))
    met = rows.where("__in").join(gone, F.col(names[docs.columns.index("doc_id")]) == gone["doc_id"], "left_anti")
    return rows.where("not __in").unionAll(met).drop("__in").toDF(*docs.columns)

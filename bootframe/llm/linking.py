"""Candidate pairs from shared keys, and connected components, without all pairs of a group.

A similarity join that only has to name connected groups need not look at every pair of a
bucket. The first round compares the members of a bucket with its smallest one, the second with
several pivots at once; links found so far are joined to components, and only buckets that still hold
several components go on. The last round compares what is left across components pair by pair, so
no link between different components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace


#: Edges of at most so many rows are joined to components in one task: their shuffles would only be overhead.
FEW = 10_000
#: Pairs of buckets that are made and verified at once: so many, or so many a row of open buckets. What a pass
#: writes then grows with the rows, not with the pairs.
PASS_PAIRS, PASS_PAIRS_ROW = 10_000_000, 4
#: Where buckets are compared in their task: members of a block of a large bucket, and rows that are dealt into blocks
#: in a pass, so many or a share of all.
BLOCK_ROWS, PASS_ROWS, PASS_SHARE = 1_000, 2_000_000, 8


def _stars(edges: DataFrame, one: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v; ``one`` is applied to what is put together."""
    both = one(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u > v")
    return one(small.unionAll(low.select("u", F.col("m").alias("v")))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none (or there are no edges)."""
    many = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return not many.unionAll(chained).take(1)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Connected components of ``edges`` (a, b: same orderable type, nulls ignored).

    Returns (node, component): every node that has a smaller one in its component, with
    the component's smallest node. Alternating large-star and small-star steps, each a
    join and a grouping whose rows stay in proportion to the edges, until only stars are left;
    each step's result is a table in the shared folder. No edges: no rows.
    """
    now = work.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    few = now.limit(FEW + 1).count() <= FEW
    one = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    now = one(now)
    while not _is_stars(now):
        now = one(work.stored(_stars(now, one), "edges"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """Rows (key, node) of keys with two or more different nodes, with ``low``, the key's smallest node.

    One shuffle by key. A key's rows meet in one task, but each node has many keys, so even
    a group of most nodes is spread over as many tasks as it shares keys; within a key the
    rows are only compared with its smallest and largest node (a window that spills to disk).
    """
    key = Window.partitionBy("key")
    return keyed.select("key", "node", F.min("node").over(key).alias("low"), F.max("node").over(key).alias("high")).where("low < high").drop("high").distinct()


def blocks(open_: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Open buckets (key, node, part, n) as blocks (key, block): a bucket of up to ``block_rows`` nodes is one, a larger
    one is cut by hash into slices, and each two of them are a block. Of a block's rows those with different ``side``
    are to be compared, and all of them where there is one side only."""
    slices = F.ceil(F.col("n") / block_rows).cast("int")
    cut = open_.withColumn("slices", slices).withColumn("side", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = cut.select("*", other.alias("other"))
    block = F.least("side", "other").cast("long") * F.col("slices") + F.greatest("side", "other")
    return dealt.select("key", block.alias("block"), "side", "node", "part")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_components(members: DataFrame, verify: Callable[[DataFrame], DataFrame], work: Workspace, pivots: int = 4, marks: DataFrame | None = None, fits: Callable[[str, str], Column] | None = None, slice_rows: int = 500, verify_fitting: Callable[[DataFrame], DataFrame] | None = None, pass_pairs: int = PASS_PAIRS, across: Callable[[DataFrame], DataFrame] | None = None, least_shared: int = 1, block_rows: int = BLOCK_ROWS, pass_rows: int = PASS_ROWS) -> tuple[DataFrame, DataFrame]:
    """Components of the links that ``verify`` confirms among nodes sharing a key.

    ``members``: stored (key, node, low). ``verify`` takes distinct pairs (a, b), a < b, and
    returns those that are links. The first round compares each bucket's members with its
    smallest node. If the buckets that still hold several components have many more
    pairs than rows, a second compares them with ``pivots`` other nodes each, picked by hash;
    the last compares all pairs of these buckets that are in different components and
    weren't compared before. Which rounds run changes the work, not the components.
    ``marks`` (node, mark: a struct) and ``fits``, a test of the columns of two marks that no link fails,
    keep pairs out of that round before they are made. A bucket is cut into slices of about ``slice_rows``
    nodes there, and a node meets each slice in a row of its own, so its pairs are made in several tasks.
    Where buckets have more than ``pass_pairs`` pairs, they take turns, a share of the keys in each pass; its pairs
    are gone before the next. ``verify_fitting`` is called in place of ``verify`` for pairs that passed ``fits``.
    ``across`` takes :func:`blocks` and returns their pairs (a, b) of different parts that may link: the last round then
    moves rows of buckets, not pairs, and its passes follow the rows. ``least_shared``: keys that a pair of the first
    round has in common; pairs with fewer, mostly chance, are left to the last round.
    Returns (components, links found).
    """
    tried = members.where("node <> low").select(F.least("low", "node").alias("a"), F.greatest("low", "node").alias("b"))
    tried = tried.distinct() if least_shared == 1 else tried.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_shared).drop("n")
    tried = work.stored(tried, "pairs")
    work.release()
    links = work.stored(verify(tried), "links")
    work.release()
    label, last = components(links, work), False
    for turn in (1, 2):
        at = members.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
        # one window over each key, not an aggregate that its rows are joined with
        key = Window.partitionBy("key")
        picked = range(pivots) if turn == 1 else ()
        others = [F.min(F.struct(F.xxhash64("node", F.lit(i + 1)).alias("h"), F.col("node").alias("other"), F.col("part").alias("other_part"))).over(key).alias(f"p{i}") for i in picked]
        seen = at.select("*", F.min("part").over(key).alias("lo"), F.max("part").over(key).alias("hi"), F.count("*").over(key).alias("n"), *others)
        # two nodes alone were compared in the first round, unless they share few keys
        open_ = work.stored(seen.where("lo < hi" if least_shared > 1 else "lo < hi and n > 2").drop("lo", "hi"), "open")
        work.release()
        rows, pairs = open_.agg(F.count("*"), F.sum((F.col("n") - 1) / 2)).first()
        if not rows:
            return label, links
        last = turn == 2 or not pivots or pairs <= 50 * rows
        # pivots make a few pairs a row, the last round all of them
        passes = max(1, math.ceil(pairs / max(pass_pairs, PASS_PAIRS_ROW * rows))) if last else 1
        if last and across:
            dealt = open_.agg(F.sum(F.ceil(F.col("n") / block_rows))).first()[0]
            passes = max(1, math.ceil(dealt / max(pass_rows, dealt / PASS_SHARE)))
        confirm = verify_fitting if last and verify_fitting and (fits or across) else verify
        news, founds = [], []
        for turn_of in range(passes):
            now = open_ if passes == 1 else open_.where(F.pmod(F.xxhash64("key", F.lit("pass")), F.lit(passes)) == turn_of)
            if last and across:
                new = across(blocks(now, block_rows))
            elif last:
                marked = now if marks is None else now.join(marks, "node")
                mark = [] if marks is None else ["mark"]
                marked = marked.select("key", "node", "part", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"), *mark)
                left = marked.withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
                right = marked.select("key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("node").alias("b"), F.col("part").alias("b_part"), *[F.col(c).alias(f"b_{c}") for c in mark])
                new = left.join(right, ["key", "slice"]).where("node < b and part <> b_part")
                new = (new if fits is None else new.where(fits("mark", "b_mark"))).select(F.col("node").alias("a"), "b")
            else:
                beside = now.select("node", "part", F.explode(F.array(*[f"p{i}" for i in picked])).alias("p"))
                new = beside.where("part <> p.other_part").select(F.col("node").alias("a"), F.col("p.other").alias("b"))
            new = work.stored(_pairs(new).join(tried, ["a", "b"], "left_anti"), "pairs")
            work.release()
            founds.append(work.stored(confirm(new), "links"))
            if last:
                work.drop(new)
            else:
                news.append(new)
            work.release()
        work.drop(open_)
        found = reduce(DataFrame.unionAll, founds)
        if found.take(1):
            label = components(label.select(F.col("component").alias("a"), F.col("node").alias("b")).unionAll(found), work)
        tried, links = reduce(DataFrame.unionAll, news, tried), links.unionAll(found.distinct() if passes > 1 else found)
        if last:
            return label, links
    raise AssertionError("the last round returns")

"""Filter interaction audit by counting paths through the lattice of filter subsets.

A document has a mask: one bit for each filter that it fails. Applying filters in some order
is a path through the subsets of filters, from none to all; an edge (state, filter) removes the
documents that pass every filter of the state and fail the new one, whatever the order in which
the state was reached. So an edge is counted once from the masks' counts, orders read
their steps from the edges, and a filter's Shapley value is the sum of its edges' removals,
each weighted by the orders through the edge: paths from the empty subset to the state
(forward) times paths from the state behind it to the full subset (backward).

Masks are counted in Spark by partial aggregation; copies of a text are one row a task before
they are shuffled, so a hot text has no hot task. Everything behind the masks' counts has at
most 2^k rows a part. Broadcast: the steps of all k! orders, ``MOST_FILTERS`` filters at most.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace, stored

#: 7 filters have 5,040 orders of 7 steps: 35,280 broadcast rows at most.
MOST_FILTERS = 7
#: Words: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def lattice(k: int) -> list[tuple[int, int, int, int]]:
    """Edges (state, filter, forward, backward) of the lattice of subsets of ``k`` filters: how
    many orders reach the state, and how many go on from the state behind the edge."""
    full = (1 << k) - 1
    edges = [(s, i) for s in range(full + 1) for i in range(k) if not s >> i & 1]
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    # a state's number is above those of its subsets
    for s, i in edges:
        reach[s | 1 << i] += reach[s]
    for s, i in reversed(edges):
        leave[s] += leave[s | 1 << i]
    return [(s, i, reach[s], leave[s | 1 << i]) for s, i in edges]


def text_failures(text: Column) -> list[Column]:
    """Which of the filters A to D a text fails: under 100 words; under 80 % different words;
    over 10 % capitals A to Z; a character of ``#$%&*|``."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    few = F.size(words) < 100
    same = F.size(F.array_distinct(words)) * 100 < F.size(words) * 80
    loud = F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10
    return [few, same, loud, text.rlike("[#$%&*|]")]


def bits(fails: Sequence[Column]) -> Column:
    """Mask of boolean columns, the first one as bit 0 (null: not failed)."""
    mask = F.lit(0)
    for i, c in enumerate(fails):
        mask = mask.bitwiseOR(F.when(c, 1 << i).otherwise(0))
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents of each part by the mask of the filters A to E that they fail.

    E fails a text that a row of smaller id has too, anywhere in the table. Returns part
    (``part_col``, null as an empty string), mask (A is bit 0), n, good, toxic (documents with a row of
    ``labels`` of quality 1, toxic 1). A null text counts as empty. Equal means equal SHA-256. Rows
    that repeat an id are documents of their own; those of equal text and id are not copies of
    each other. A null id is smaller than none, has none smaller and no label.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits(text_failures(text)).alias("mask"))
    rows = rows.groupBy("doc", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # rows without an id are dealt by their text
    rows = rows.withColumn("key", F.coalesce("doc", F.xxhash64("digest"))).withColumn("known", F.col("doc").isNotNull())
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    met = rows.join(marks.withColumn("known", F.lit(True)), ["key", "known"], "left").fillna(0, ["good", "toxic"])
    # all rows of a text have its mask, so a text is a few rows: by part and label, with its smallest id
    texts = met.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc").alias("low"), F.min_by("n", "doc").alias("n_low"), F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    lowest = texts.groupBy("digest").agg(F.min("low").alias("lowest"), F.count("*").alias("rows"))
    several = lowest.where("rows > 1").select("digest", "lowest")
    texts = texts.join(several, "digest", "left")
    first = F.col("n_null") + F.when(F.col("low") <= F.coalesce("lowest", "low"), F.col("n_low")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), first.alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - first).alias("n")))
    split = texts.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def interactions(masks: DataFrame, filters: str) -> DataFrame:
    """What each filter does at each step of each order.

    ``masks``: part, mask, n, good, toxic (one row a part and mask); ``filters``: a letter a
    bit. Returns a row, zeros included, per part, filter_order (every permutation of the
    letters) and step (from 1; its filter is that letter): kept (documents left after it),
    removed (by it), redundant (fail it, but were removed before), unique_fails (fail it
    alone), good_lost, toxic_lost (of those removed), shapley (its removals summed over all
    orders). Parts without a row of ``masks`` don't occur; no rows, no result.
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS or len(set(filters)) < k:
        raise ValueError(f"filters are 1 to {MOST_FILTERS} different letters")
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter"), F.lit(1 << i).alias("bit"), F.lit(into * out).cast("long").alias("orders")) for s, i, into, out in lattice(k)])
    at = masks.select("*", F.explode(edges).alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    alive, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    edge = at.groupBy("part", "state", "filter", "orders").agg(
        total("n", alive & ~fails).alias("kept"),
        total("n", alive & fails).alias("removed"),
        total("n", ~alive & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", alive & fails).alias("good_lost"),
        total("toxic", alive & fails).alias("toxic_lost"),
    )
    worth = edge.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = []
    for order in permutations(range(k)):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(filters[x] for x in order), step, state, i))
            state |= 1 << i
    steps = masks.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    out = edge.join(worth, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """:func:`interactions` of the filters A to E on ``docs``, see :func:`mask_counts`. ``labels``
    (id, quality, toxic) may repeat ids and hold nulls. Other columns are ignored. An empty
    table gives an empty result."""
    work = Workspace(docs.sparkSession, "audit")
    masks = work.stored(mask_counts(docs, labels, id_col, text_col, part_col), "masks")
    out = stored(interactions(masks, "ABCDE"), "audit")
    work.close()
    return out


def _sql() -> str:
    letters = {"A": "a", "B": "b", "C": "c", "D": "d", "E": "e"}
    after = {x: " OR ".join(f"(strpos(filter_order, '{x}') <= step AND {c})" for x, c in letters.items()) for x in letters}
    gone = " OR ".join(after.values())
    before = " OR ".join(f"(strpos(filter_order, '{x}') < step AND {c})" for x, c in letters.items())
    mine = "CASE substr(filter_order, step, 1) " + " ".join(f"WHEN '{x}' THEN {c}" for x, c in letters.items()) + " END"
    alone = f"{mine} AND a::int + b::int + c::int + d::int + e::int = 1"
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
    failed AS (SELECT part, doc_id, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM words),
    marks AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
    docs AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL),
    l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
        WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
    steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::int AS step FROM orders),
    counts AS (SELECT part, filter_order, step,
        coalesce(sum(n) FILTER (NOT ({gone})), 0)::bigint AS kept,
        coalesce(sum(n) FILTER ({mine} AND NOT ({before})), 0)::bigint AS removed,
        coalesce(sum(n) FILTER ({mine} AND ({before})), 0)::bigint AS redundant,
        coalesce(sum(n) FILTER ({alone}), 0)::bigint AS unique_fails,
        coalesce(sum(good) FILTER ({mine} AND NOT ({before})), 0)::bigint AS good_lost,
        coalesce(sum(toxic) FILTER ({mine} AND NOT ({before})), 0)::bigint AS toxic_lost
        FROM docs CROSS JOIN steps GROUP BY ALL)
    SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::bigint AS shapley FROM counts
    """


#: DuckDB SQL for the rows of :func:`audit` over ``documents`` and ``labels``: every order applied step by step.
ORACLE = _sql()

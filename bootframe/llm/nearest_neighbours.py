"""Approximate nearest neighbours: a forest of random-projection trees, exact reranking.

Trees are grown on the driver from a sample of at most ``SAMPLE_ROWS`` vectors: each node cuts
its points by the plane halfway between two of them. Every vector of the table is put into one
leaf a tree. A query walks all trees through one priority queue, always taking the node whose
worst margin is best, until it has its leaves; how many it needs is measured on the sample. Leaves are then joined with vectors on (tree,
leaf), each task ranks its candidates by exact distance and passes on the nearest few.

Equal vectors are one candidate, however many rows have them, and equal queries search once;
rows come back in at the end. Broadcast: the forest, bounded by the sample. Memory: a leaf's
slice of about ``SLICE_ROWS`` vectors and the queries that look into it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, opened, shared, stored

#: Vectors that the trees are grown on at most.
SAMPLE_ROWS = 65_536
#: Vectors of a leaf that one task ranks at once, about.
SLICE_ROWS = 4_000
#: Distances that are held at once.
BLOCK = 2_000_000


class Forest:
    """Random-projection trees as arrays; children below 0 are leaves (-1 - leaf)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(sample, leaf_rows, rng) for _ in range(trees)]

    @staticmethod
    def _grow(points: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        normals, cuts, children, leaves = [], [], [], 0
        open_: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]
        while open_:
            rows, parent, side = open_.pop()
            normal = None
            if len(rows) > leaf_rows:
                for _ in range(3):
                    a, b = points[rng.choice(rows, 2, replace=False)].astype(np.float64)
                    if (length := np.linalg.norm(a - b)) > 0:
                        normal = (a - b) / length
                        cut = float(normal @ (a + b) / 2)
                        up = points[rows] @ normal > cut
                        if 0 < up.sum() < len(rows):
                            break
                        normal = None
            if normal is None:
                node = -1 - leaves
                leaves += 1
            else:
                node = len(cuts)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                open_ += [(rows[~up], node, 0), (rows[up], node, 1)]
            if parent >= 0:
                children[parent][side] = node
        dim = points.shape[1]
        return np.array(normals, np.float32).reshape(-1, dim), np.array(cuts, np.float32), np.array(children, np.int64).reshape(-1, 2)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.trees)), np.int32)
        for t, (normals, cuts, children) in enumerate(self.trees):
            node = np.zeros(len(vectors), np.int64) if len(cuts) else np.full(len(vectors), -1)
            while (inside := np.flatnonzero(node >= 0)).size:
                at = node[inside]
                side = (np.einsum("ij,ij->i", vectors[inside], normals[at]) > cuts[at]).astype(int)
                node[inside] = children[at, side]
            out[:, t] = -1 - node
        return out

    def visited(self, vector: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The ``leaves`` (tree, leaf) that the shared queue reaches first."""
        queue = [(-np.inf, t, 0 if len(cuts) else -1) for t, (_, cuts, _) in enumerate(self.trees)]
        margins = [normals @ vector - cuts for normals, cuts, _ in self.trees]
        heapq.heapify(queue)
        out = []
        while queue and len(out) < leaves:
            worst, t, node = heapq.heappop(queue)
            if node < 0:
                out.append((t, -1 - node))
                continue
            margin, (low, high) = float(margins[t][node]), self.trees[t][2][node]
            heapq.heappush(queue, (max(worst, margin), t, int(low)))
            heapq.heappush(queue, (max(worst, -margin), t, int(high)))
        return out


def leaves_needed(forest: Forest, sample: np.ndarray, k: int, recall: float, queries: int = 100) -> int:
    """How many leaves a query must visit to meet ``recall`` of its ``k`` nearest, measured by
    brute force on the sample for its first vectors."""
    points = sample.astype(np.float64)
    at = forest.leaves(sample)
    squares = (points**2).sum(axis=1)
    needed: list[int] = []
    for q in range(min(queries, len(sample))):
        far = squares - 2 * (points @ points[q])
        far[q] = np.inf
        near = np.argpartition(far, min(k, len(far) - 1))[:k]
        turn = {leaf: i for i, leaf in enumerate(forest.visited(sample[q], 2**31), 1)}
        needed += [min(turn[t, leaf] for t, leaf in enumerate(at[i])) for i in near if i != q]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.empty((0, 0))


def _ranked(keep: int):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            points, ids = _matrix(rows["vector"]), rows["node"].to_numpy()
            step = max(1, BLOCK // (len(rows) * points.shape[1]))
            for a in range(0, len(queries), step):
                part = queries.iloc[a : a + step]
                asked = _matrix(part["vector"])
                far = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
                for q, row in zip(part["query"], far):
                    # ties at the edge stay: the final rank breaks them
                    edge = np.partition(row, keep - 1)[keep - 1] if len(row) > keep else np.inf
                    at = np.flatnonzero(row <= edge)
                    found.append(pd.DataFrame({"query": q, "node": ids[at], "score": row[at]}))
        return pd.concat(found) if found else pd.DataFrame({"query": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 12, leaf_rows: int = 256, recall: float = 0.95, seed: int = 0) -> DataFrame:
    """The ``k`` nearest other rows found for each row for which ``is_query`` (a column) holds.

    Returns query_id, rank (from 1), id, score (Euclidean distance in double precision of the
    original vectors), nearest first, ties to the smaller id; fewer rows where there are
    fewer candidates. Vectors that are null, empty, zero, of another length than most of the sample, or
    hold null or non-finite numbers take no part, nor do rows with a null id. Rows that
    repeat an id and vector count once; an id with several vectors is several candidates.
    Distances are exact. That all nearest are found isn't certain: each query visits as many
    leaves as meet ``recall`` on the sample, by brute force for some of its vectors.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "nearest")
    # floats stay as they are (half the bytes); other numbers count in double precision
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).first()
    if lengths is None:
        work.close()
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows = work.stored(rows.where(F.size("vector") == lengths["n"]).dropDuplicates(["id", "vector"]), "rows")
    # classes of equal vectors, each with its k + 1 smallest ids
    first = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    asking = rows.where("asks").select("vector").distinct().withColumn("asks", F.lit(True))
    classes = few.join(asking, "vector", "left").select("vector", "members", F.coalesce("asks", F.lit(False)).alias("asks"), F.xxhash64("vector").alias("node"))
    classes = work.stored(classes, "classes")
    n = classes.count()
    sample = classes.select("node", "vector").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(SAMPLE_ROWS).toPandas()
    forest = Forest(np.stack(sample["vector"].to_list()).astype(np.float32), trees, leaf_rows, seed)
    leaves = leaves_needed(forest, np.stack(sample["vector"].to_list()).astype(np.float32), k, recall)
    sent = shared(spark, forest)
    slices = max(1, -(-n * leaf_rows // (min(n, SAMPLE_ROWS) * SLICE_ROWS)))

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = opened(sent)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.iloc[a : a + 500]
                at = forest.leaves(np.stack(part["vector"].to_list()).astype(np.float32))
                again = part.iloc[np.repeat(np.arange(len(part)), at.shape[1])]
                yield pd.DataFrame({"tree": np.tile(np.arange(at.shape[1], dtype=np.int32), len(part)), "leaf": at.ravel(), "slice": (again["node"].to_numpy() % slices).astype(np.int32), "node": again["node"].to_numpy(), "vector": again["vector"].to_numpy()})

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = opened(sent)
        for batch in batches:
            for query, vector in zip(batch["node"], batch["vector"]):
                out = [(t, leaf, s) for t, leaf in forest.visited(np.asarray(vector, np.float32), leaves) for s in range(slices)]
                yield pd.DataFrame(out, columns=["tree", "leaf", "slice"]).astype("int32").assign(query=query, vector=[vector] * len(out))

    key = ["tree", "leaf", "slice"]
    in_leaf = classes.select("node", "vector").mapInPandas(filed, f"tree int, leaf int, slice int, node long, vector array<{kind}>")
    looks = classes.where("asks").select("node", "vector").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "node").mapInPandas(asked, f"tree int, leaf int, slice int, query long, vector array<{kind}>")
    # only leaves that are looked into
    in_leaf = in_leaf.join(looks.select(*key).distinct(), key, "left_semi")
    near = in_leaf.groupBy(*key).cogroup(looks.groupBy(*key)).applyInPandas(_ranked(k + 1), "query long, node long, score double")
    near = work.stored(near.distinct(), "near")
    # up to k + 1 nearest classes give the k nearest rows; ties between classes go by their smallest id
    named = near.join(classes.select("node", "members"), "node")
    best = Window.partitionBy("query").orderBy("score", F.col("members")[0])
    top = named.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    ids = top.select("query", "score", F.explode("members").alias("id"))
    order = Window.partitionBy("query").orderBy("score", "id")
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found"))
    answers = rows.where("asks").select(F.col("id").alias("query_id"), F.xxhash64("vector").alias("query")).join(ids, "query")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("r", "x")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
    out = stored(out, "nearest")
    work.close()
    return out

"""Centroid clustering of integer vectors by a bisector tournament.

A vector is nearer to centroid b than to a smaller-numbered centroid a exactly if
``2 (b - a) . v > |b|^2 - |a|^2``: the side of the two centroids' bisector it lies on. Normals
and thresholds of all pairs are computed once a round, in integers. A vector's first champion is
centroid 0; each further centroid is tested against the champion, one linear sign test, and
replaces it if the sign is positive (zero leaves the smaller number). After k - 1 tests the
champion is the nearest centroid; its distance is then computed exactly.

Rounds of assignment and replacement are Spark jobs over a stored table of integer vectors.
A task adds up its vectors by cluster and sends k rows of sums, Spark adds these by component,
and the driver sees k * dim numbers. Broadcast: the k * k * dim pair table (``PAIR_BYTES`` at
most). All arithmetic is exact: 64-bit integers where a batch's distances fit, else Python's.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, opened, shared, stored

#: Bytes of the pair table at most.
PAIR_BYTES = 256 << 20
#: Vectors that meet the pair table at once.
BLOCK = 2_000
#: Components up to this size have distances and thresholds that fit 64 bits (up to 2^12 of them).
SMALL = 1 << 24


class Bisectors:
    """Normals and thresholds of all pairs of centroids (an integer matrix, a row a centroid)."""

    def __init__(self, centroids: list[list[int]]) -> None:
        small = all(abs(x) <= SMALL for c in centroids for x in c) and (not centroids or len(centroids[0]) <= 4096)
        self.at = np.array(centroids, np.int64 if small else object)
        self.normals = 2 * (self.at[None, :, :] - self.at[:, None, :])
        squares = (self.at * self.at).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]
        self.small = small

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, the smaller one of equally near ones, and
        the squared distance."""
        if not self.small or (vectors.size and max(-int(vectors.min()), int(vectors.max())) > SMALL):
            vectors = vectors.astype(object)
        champion = np.zeros(len(vectors), np.int64)
        for rival in range(1, len(self.at)):
            side = (vectors * self.normals[champion, rival]).sum(axis=1) - self.thresholds[champion, rival]
            champion[(side > 0).astype(bool)] = rival
        apart = vectors - self.at[champion]
        return champion, (apart * apart).sum(axis=1)


def _rows(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The vectors of a batch, a block at a time."""
    flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for a in range(0, len(flat), BLOCK):
        yield slice(a, a + BLOCK), flat[a : a + BLOCK]


def _sums(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = opened(sent)
        k = len(bisectors.at)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            for _, vectors in _rows(batch, dim):
                nearest, _ = bisectors.nearest(vectors)
                count += np.bincount(nearest, minlength=k)
                for c in np.unique(nearest):
                    part = vectors[nearest == c]
                    # sums of a block of components below 2^51 fit 64 bits
                    exact = part if max(-int(part.min()), int(part.max())) < 1 << 51 else part.astype(object)
                    total[c] += exact.sum(axis=0).astype(object)
        met = np.flatnonzero(count)
        # decimal text: Spark adds these as decimals of 38 digits
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, pa.int32()), "n": pa.array(count[met], pa.int64()), "total": pa.array([[str(x) for x in total[c]] for c in met], pa.list_(pa.string()))})

    return run


def _assigned(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = opened(sent)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for at, vectors in _rows(batch, dim):
                nearest, far = bisectors.nearest(vectors)
                part = ids.slice(at.start, len(vectors))
                yield pa.RecordBatch.from_pydict({"id": part, "cluster": pa.array(nearest, pa.int32()), "distance": pa.array([int(x) if x < 1 << 63 else None for x in far] if far.dtype == object else far, pa.int64())})

    return run


def _whole(dim: int, scale: int):
    """Kept vectors as integers floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not np.abs(flat).max() < 2.0**62 / scale:
                raise ValueError(f"a component times {scale} is beyond 2^62")
            whole = np.floor(flat * scale).astype(np.int64)
            offsets = pa.array(np.arange(0, len(whole) + 1, dim), pa.int32())
            yield pa.RecordBatch.from_pydict({"id": batch.column(batch.schema.get_field_index("id")), "vector": pa.ListArray.from_arrays(offsets, pa.array(whole, pa.int64()))})

    return run


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest lowercase-hex SHA-256 of ``1:<id>``, by it; a null id
    comes last, equal ids go by their vectors."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    found = rows.select(mark.alias("mark"), "vector").orderBy(F.col("mark").asc_nulls_last(), "vector").limit(k).collect()
    return [list(r["vector"]) for r in found]


def next_centroids(rows: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Each centroid's vectors' floor(sum / count) by component; one without vectors stays."""
    sent = shared(rows.sparkSession, Bisectors(centroids))
    parts = rows.select("vector").mapInArrow(_sums(sent, dim), "cluster int, n long, total array<string>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [list(c) for c in centroids]
    for r in sums:
        out[r["cluster"]][r["place"]] = int(r["x"]) // r["n"]
    return out


def clusters(vectors: DataFrame, dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Clusters of the vectors with exactly ``dim`` components, none null or non-finite.

    Components x become floor(``scale`` * x) in double precision. Centroids start as
    :func:`first_centroids` (as many as there are vectors, if fewer than ``k``); each of ``rounds``
    rounds assigns every vector and replaces the centroids; then vectors are assigned once more.
    Returns per kept row: id, cluster (from 0), distance (squared, to its centroid),
    cluster_inertia (sum over its cluster), inertia (over all), centroid_sha256 (lowercase hex
    SHA-256 of the centroid's components with commas between). Rows that repeat an id or a vector are
    vectors of their own; a null id is kept as null. Other columns are ignored. Nothing kept:
    an empty result. A component beyond 2^62 once scaled raises; a sum or distance beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    if k * k * dim * 8 > PAIR_BYTES:
        raise ValueError(f"the pair table of {k} centroids of {dim} components is over {PAIR_BYTES} bytes")
    if min(dim, k, scale) < 1 or rounds < 0:
        raise ValueError("dim, k and scale are positive, rounds isn't negative")
    work = Workspace(spark, "clusters")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where((F.size("vector") == dim) & finite)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = work.stored(rows.mapInArrow(_whole(dim, scale), f"id {kind}, vector array<long>"), "vectors")
    centroids = first_centroids(rows, k)
    if not centroids:
        work.close()
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids, dim)
    sent = shared(spark, Bisectors(centroids))
    found = work.stored(rows.mapInArrow(_assigned(sent, dim), f"id {kind}, cluster int, distance long"), "assigned")
    out = stored(found.join(F.broadcast(summary(spark, found, centroids)), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    work.close()
    return out


def summary(spark: SparkSession, found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """A row a cluster that has vectors (k at most): its inertia, the whole one, its centroid's digest."""
    far = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()}
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    sums = {c: int(r["sum"]) if r["known"] == r["n"] else None for c, r in far.items()}
    whole = fits(None if None in sums.values() else sum(sums.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = pd.DataFrame([(c, fits(s), whole, digest[c]) for c, s in sums.items()], columns=["cluster", "cluster_inertia", "inertia", "centroid_sha256"])
    return spark.createDataFrame(list(rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)), "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def _sql(dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    far{r} AS (SELECT v.i, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint AS distance FROM parts v JOIN c{r} c USING (place) GROUP BY ALL),
    near{r} AS (SELECT i, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM far{r} GROUP BY i),""")
        if r < rounds:
            steps.append(f"""
    mean{r} AS (SELECT cluster, place, floor(sum(x)::double / count(*))::bigint AS about, sum(x)::hugeint AS s, count(*) AS n FROM parts JOIN near{r} USING (i) GROUP BY ALL),
    exact{r} AS (SELECT cluster, place, about + (CASE WHEN about * n > s THEN -1 WHEN (about + 1) * n <= s THEN 1 ELSE 0 END) AS x FROM mean{r}),
    c{r + 1} AS (SELECT cluster, place, coalesce(e.x, c.x)::bigint AS x FROM c{r} c LEFT JOIN exact{r} e USING (cluster, place)),""")
    return f"""
    WITH kept AS (SELECT row_number() OVER () AS i, vec_id, embedding FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT i, vec_id, unnest(range({dim})) AS place, unnest(list_transform(embedding, lambda x: floor({scale} * x::double)::bigint)) AS x FROM kept),
    firsts AS (SELECT i, row_number() OVER (ORDER BY sha256('1:' || vec_id::varchar)) - 1 AS cluster FROM kept QUALIFY cluster < {k}),
    c0 AS (SELECT cluster, place, x FROM parts JOIN firsts USING (i)),{"".join(steps)}
    digests AS (SELECT cluster, sha256(string_agg(x::varchar, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
    SELECT vec_id, cluster::int AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::bigint AS cluster_inertia,
        sum(distance) OVER ()::bigint AS inertia, centroid_sha256
    FROM near{rounds} JOIN kept USING (i) JOIN digests USING (cluster)
    """


#: DuckDB SQL for the rows of :func:`clusters` over ``embeddings`` with its defaults: all distances of every round.
ORACLE = _sql()

"""Exact top-k by integer inner product, over an impact-ordered score-at-a-time index.

Components are quantised to floor(64 x). A portion of the vectors is indexed by component: a component's postings are the vectors that have it and
its impact there, cut into segments by the size of the impact, the largest first. A group of queries takes one segment after the other, of
all components, and adds each posting to its accumulators. What is left of a vector beyond the segments seen has a known norm, and no
component of it is as large as the segment's floor; so by Cauchy and Schwarz, and by the query's sum of sizes, its score is at most the score
so far plus the less of the two products. A vector that cannot
reach the query's threshold is out by proof; a query of which few are left stops, and these possible members are scored exactly. The
threshold is the k-th best exact score among the query's fellow queries, which are candidates too, so it is never too high; tasks compute
it, each for a part of the queries.

Queries go out in blocks of bounded size; each block is held against all vectors, and every portion answers with at most k of its members,
so nothing grows with the square of a group.

Edge cases: vectors that are null or hold a null or a non-finite component take no part; vectors are compared with
those of the same number of components only. Ties go to the smaller id; a query's own id is not among its results, also where rows repeat it; a repeated query
id is asked once, with the vector that is smallest in order. Null ids take no part. An empty table gives an empty result. Components are exact up to 2^24 in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch_path, thrifty, written

SCALE = 64
#: Vectors in one index, queries in one block.
PORTION, BLOCK = 1 << 14, 1 << 13
#: Parts of the postings that have been seen after each segment.
SEGMENTS = (0.25, 0.5, 0.75, 1.0)
#: Queries that go through the segments together.
TOGETHER = 256
#: Part of the vectors that may be left when they are scored exactly.
FEW = 1 / 16


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


class Index:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        """vectors: n x d whole numbers. segments: of each, the postings by component (places, impacts), its floor, and what is left of the norms."""
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        size = np.abs(vectors)
        ranked = np.sort(size, axis=None)
        n = len(ranked)
        # Least impacts of the segments; equal impacts never lie in two.
        floors = sorted({int(ranked[max(0, n - int(np.ceil(n * part)))]) for part in SEGMENTS}, reverse=True) if n else []
        left = (self.vectors**2).sum(axis=1)
        self.largest = int(ranked[-1]) if n else 0
        self.segments = []
        upper = None
        for low in floors:
            own = (size >= low) & (size > 0) if upper is None else (size >= max(low, 1)) & (size < upper)
            postings = []
            for j in range(vectors.shape[1]):
                at = np.flatnonzero(own[:, j])
                postings.append((at, self.vectors[at, j]))
            left = left - (np.where(own, self.vectors, 0.0) ** 2).sum(axis=1)
            self.segments.append((postings, max(0, low - 1) if low else 0, np.sqrt(np.maximum(left, 0))))
            upper = low

    def search(self, query_ids: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query the ids and scores of the best k of this index that reach its threshold."""
        for s in range(0, len(query_ids), TOGETHER):
            yield from self._block(query_ids[s : s + TOGETHER], queries[s : s + TOGETHER].astype(np.float64), thresholds[s : s + TOGETHER], k)

    def _block(self, query_ids: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n = len(self.ids)
        few = max(2 * k, int(n * FEW))
        live = np.arange(len(query_ids))
        norm, total = np.sqrt((queries**2).sum(axis=1)), np.abs(queries).sum(axis=1)
        # Sums of whole numbers: exact in 32 bits up to 2^24.
        kind = np.float32 if self.largest * total.max(initial=0) < 1 << 24 else np.float64
        score = np.zeros((n, len(live)), kind)
        for depth, (postings, most, left) in enumerate(self.segments):
            for j, (at, impact) in enumerate(postings):
                if len(at):
                    score[at] += impact.astype(kind)[:, None] * queries[live, j].astype(kind)
            # A score of at least this much so far may still reach the threshold.
            needed = (thresholds[live] - 1e-3)[None, :] - np.minimum(left[:, None] * norm[live], most * total[live])
            possible = score >= needed
            done = (possible.sum(axis=0) <= few) | (depth == len(self.segments) - 1)
            for i in np.flatnonzero(done):
                at = np.flatnonzero(possible[:, i])
                yield self._exact(int(query_ids[live[i]]), queries[live[i]], float(thresholds[live[i]]), at, k)
            live, score = live[~done], score[:, ~done]
            if not len(live):
                return
        for i in live:  # no segments: vectors without components
            yield self._exact(int(query_ids[i]), queries[i], float(thresholds[i]), np.arange(n), k)

    def _exact(self, query_id: int, query: np.ndarray, threshold: float, at: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        ids, scores = self.ids[at], self.vectors[at] @ query
        fit = (ids != query_id) & (scores >= threshold)
        ids, scores = ids[fit], scores[fit]
        best = np.lexsort((ids, -scores))[:k]
        return query_id, ids[best], scores[best].astype(np.int64)


def thresholds(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Of the queries at the places own, the k-th best score among the other queries: as low as the true k-th best or lower."""
    out = np.full(len(own), -np.inf)
    v = vectors.astype(np.float64)
    for s in range(0, len(own), TOGETHER):
        at = own[s : s + TOGETHER]
        scores = v[at] @ v.T
        scores[np.arange(len(at)), at] = -np.inf
        if scores.shape[1] > k:
            out[s : s + TOGETHER] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    return out


def _lowest(held, k: int):
    """size, place and threshold of the queries of a block; rows: the places of some, by the number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        for b in batches:
            size, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "place"))
            out = np.zeros(len(size))
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                out[own] = thresholds(*queries[n], place[own], k)
            yield pa.RecordBatch.from_arrays([b.column("size"), b.column("place"), pa.array(out)], ["size", "place", "least"])

    return run


def _portion(held, k: int):
    def answer(ids: list[int], vectors: list[list[int]]) -> Iterator[pa.RecordBatch]:
        queries, least = held.value
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        out = []
        for size, own in by_size.items():
            if size not in queries:
                continue
            index = Index(np.array([ids[i] for i in own], np.int64), np.array([vectors[i] for i in own], np.int64).reshape(len(own), size))
            for query_id, found, scores in index.search(*queries[size], least[size], k):
                out.append((np.full(len(found), query_id, np.int64), found, scores))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[int]] = []
        for b in batches:
            ids += b.column(0).to_pylist()
            vectors += b.column(1).to_pylist()
            while len(ids) >= PORTION:
                yield from answer(ids[:PORTION], vectors[:PORTION])
                ids, vectors = ids[PORTION:], vectors[PORTION:]
        if ids:
            yield from answer(ids, vectors)

    return run


def top_k(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. Queries: rows whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = df.where(usable(df[vector_col]) & df[id_col].isNotNull()).select(df[id_col].cast("long").alias("vec_id"), quantised(df[vector_col]).alias("v"))
    n = df.count()
    rows = written(rows.repartition(max(1, -(-n // (PORTION // 2)))), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Blocks by a hash; each is collected by itself, BLOCK queries or so.
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("block").sortWithinPartitions("block"), "queries")
    path = scratch_path(spark, "topk")
    schema = "query_id long, vec_id long, score long"
    for block in range(blocks):
        by_size: dict[int, list[tuple[int, list[int]]]] = {}
        for r in asked.where(F.col("block") == block).select("vec_id", "v").collect():
            by_size.setdefault(len(r.v), []).append((r.vec_id, r.v))
        queries = {}
        for size, own in by_size.items():
            own.sort()
            ids, vectors = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64).reshape(len(own), size)
            queries[size] = (ids, vectors)
        asked_for = spark.sparkContext.broadcast(queries)  # BLOCK queries or so
        places = pa.table({"size": pa.array([n for n, (ids, _) in queries.items() for _ in ids], pa.int32()), "place": pa.array([i for ids, _ in queries.values() for i in range(len(ids))], pa.int32())})
        found = spark.createDataFrame(places).repartition(partitions(spark)).mapInArrow(_lowest(asked_for, k), "size int, place int, least double").collect()
        least = {n: np.full(len(ids), -np.inf) for n, (ids, _) in queries.items()}
        for n, i, x in found:
            least[n][i] = x
        held = spark.sparkContext.broadcast((queries, least))
        rows.mapInArrow(thrifty(_portion(held, k)), schema).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

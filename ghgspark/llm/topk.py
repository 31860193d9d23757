"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments, coarse to fine. With means m and deviations d (the norm of what is left after the mean)
of each segment of length L, the inner product of q and x is at most sum(L m_q m_x + d_q d_x): a lower bound on their
distance, since |q - x|^2 = |q|^2 + |x|^2 - 2 q.x. Pairs whose bound is below the query's k-th best score so far are
dropped level by level; the survivors' products are exact. Integers below 2^53 keep every sum exact in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import gapless, staged
from ghgspark.session import scratch_path

LEVELS = (1, 4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means (times the root of the segment's length) and deviations of every row; their products give the bound."""
    ends = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lengths = np.diff(ends)
    means = np.add.reduceat(x, ends[:-1], axis=1) / lengths
    left = x - np.repeat(means, lengths, axis=1)
    return np.hstack([means * np.sqrt(lengths), np.sqrt(np.add.reduceat(left * left, ends[:-1], axis=1))])


def survivors(query: list[np.ndarray], rows: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) whose bound reaches ``least`` at every level."""
    q, r = np.arange(len(least)), np.arange(len(rows[0]))
    alive = np.ones((len(q), len(r)), bool)
    for left, right in zip(query, rows):
        bound = left[q] @ right[r].T
        alive &= bound + 1e-9 * np.abs(bound) + 1e-6 >= least[q][:, None]
        some_q, some_r = alive.any(axis=1), alive.any(axis=0)
        q, r, alive = q[some_q], r[some_r], alive[some_q][:, some_r]
        if not len(q):
            break
    at_q, at_r = np.nonzero(alive)
    return q[at_q], r[at_r]


class Best:
    """The k best (score, id) per query among what was offered; ``least`` is each query's k-th best score."""

    def __init__(self, least: np.ndarray, k: int, room: int = 400_000):
        self.least, self.k, self.room = least.copy(), k, room
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((query, ids, scores))
        self.size += len(query)
        if self.size > self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], scores[last])
        keep = place < self.k
        self.parts = [(query[keep], ids[keep], scores[keep])]
        self.size = int(keep.sum())
        self.room = max(self.room, 2 * self.size)
        return self.parts[0]


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Rows of one width as floor(scale * x)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * values.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def search_block(ids: np.ndarray, vectors: np.ndarray, k: int, stored_ids: np.ndarray, stored: np.ndarray):
    """A task body that finds, per query of the block, its partition's k best rows that can be among all rows' k best.

    ``stored_ids`` and ``stored`` are any of the searched rows: a query's k-th best score among them, its own id left out,
    is a floor for every partition.
    """
    levels = [statistics(vectors, s) for s in LEVELS]
    floor = np.full(len(ids), -np.inf)
    if len(stored_ids) >= k:
        scores = np.where(ids[:, None] == stored_ids[None, :], -np.inf, vectors @ stored.T)
        floor = np.partition(scores, -k, axis=1)[:, -k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floor, k)
        for batch in batches:
            names = batch.column("vec_id").to_numpy()
            x = matrix(batch.column("embedding"), 1.0)
            for low in range(0, len(names), 1024):
                part, own = x[low:low + 1024], names[low:low + 1024]
                rows = [statistics(part, s) for s in LEVELS]
                for start in range(0, len(ids), 512):
                    chunk = slice(start, start + 512)
                    q, r = survivors([level[chunk] for level in levels], rows, best.least[chunk])
                    for a in range(0, len(q), 1 << 17):
                        i, j = q[a:a + (1 << 17)] + start, r[a:a + (1 << 17)]
                        exact = np.einsum("ij,ij->i", vectors[i], part[j])
                        keep = (exact >= best.least[i]) & (own[j] != ids[i])
                        best.offer(i[keep], own[j[keep]], exact[keep].astype(np.int64))
            best.settle()
        query, found, exact = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query], pa.int64()), pa.array(found, pa.int64()), pa.array(exact.astype(np.int64))],
            names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block: int = 2048) -> DataFrame:
    """Each query's ``k`` highest integer inner products floor(scale x).floor(scale y): query_id, rank, vec_id, score.

    Vectors and queries have vec_id and embedding. Ties go to the smaller vec_id. Rows with the query's vec_id are its
    own and no candidates; other repeated rows are candidates each. Of queries with one vec_id the smallest vector
    counts. Null ids, null vectors and vectors with null or non-finite components take no part; vectors of another
    width are no candidates, an empty vector has no width. An empty table gives no rows.

    Queries go through in blocks of ``block`` rows, every block against all rows; a task returns at most k rows per query.
    A block's result is written before the next block is read, so the driver holds one block (and as many stored rows),
    and no plan has more than one, however many queries there are.
    """
    def usable(frame: DataFrame) -> DataFrame:
        return frame.where(
            "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and "
            "abs(x) < double('infinity'))"
        ).select(F.col("vec_id").cast("long"), F.expr(f"transform(embedding, x -> floor({scale} * double(x)))")
                 .cast("array<double>").alias("embedding"))

    rows = staged(usable(vectors).withColumn("width", F.size("embedding")), "vectors")
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = staged(gapless(asked.withColumn("width", F.size("embedding")), ["width"], ["vec_id"], "number"), "queries")
    spark = vectors.sparkSession
    found, kinds = scratch_path(spark, "top-k"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], kinds).write.parquet(found)
    for width, n in sorted((r["width"], r["count"]) for r in asked.groupBy("width").count().collect()):
        stored = rows.where(f"width = {width}").select("vec_id", "embedding")
        some = stored.limit(block).toPandas()
        if not len(some):
            continue
        some_ids, some_vectors = some["vec_id"].to_numpy(np.int64), np.vstack(some["embedding"].to_numpy())
        for low in range(0, n, block):
            part = asked.where(f"width = {width} and number >= {low} and number < {low + block}").orderBy("number").toPandas()
            run = search_block(part["vec_id"].to_numpy(np.int64), np.vstack(part["embedding"].to_numpy()), k,
                               some_ids, some_vectors)
            stored.mapInArrow(run, "query_id long, vec_id long, score long").selectExpr(
                "query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score"
            ).where(f"rank <= {k}").write.mode("append").parquet(found)
    return spark.read.schema(kinds).parquet(found)

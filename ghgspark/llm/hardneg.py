"""Hard-negative mining with segment summary filtering.

Each vector is cut into 1, 4 and 16 segments; a segment keeps its mean and the norm of what is left after the mean.
For two vectors, a segment's product is L * mean * mean' plus the product of the two remainders, which Cauchy-Schwarz
holds within +-(norm * norm'). Summed over segments this gives a lower and an upper bound of the inner product; finer
levels tighten it. Pairs whose bounds cannot reach a wanted score range are dropped level by level, and only the rest
get an exact integer product.

Anchors and rows are dealt into blocks; each (anchor block, row block) pair of one width is one task, which keeps at
most the wanted number of rows per anchor (and per positive) before any shuffle. The result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import staged

LEVELS = (1, 4, 16)
#: Share of surviving pairs above which a chunk's exact products are one matrix product.
DENSE = 0.125


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: means times the root of the segment length, and remainder norms (rows x segments each)."""
    out = []
    for segments in LEVELS:
        ends = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
        lengths = np.diff(ends)
        means = np.add.reduceat(x, ends[:-1], axis=1) / lengths
        left = x - np.repeat(means, lengths, axis=1)
        out.append((means * np.sqrt(lengths), np.sqrt(np.add.reduceat(left * left, ends[:-1], axis=1))))
    return out


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all products between the rows of two summaries, widened by rounding room."""
    centre, radius = a[0] @ b[0].T, a[1] @ b[1].T
    room = 1e-9 * (np.abs(centre) + radius) + 1e-6
    return centre - radius - room, centre + radius + room


def kth(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th largest allowed value, -inf where fewer than k are allowed."""
    masked = np.where(allowed, values, -np.inf)
    if masked.shape[1] < k:
        return np.full(len(masked), -np.inf)
    return np.partition(masked, -k, axis=1)[:, -k]


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows, len(values) // rows) if rows else np.zeros((0, 0))


def survivors(anchor_x: np.ndarray, rows_x: np.ndarray, keep) -> np.ndarray:
    """Boolean (anchor, row) mask of pairs that ``keep(lower, upper, alive, columns)`` lets through at every level.

    A finer level looks only at the rows still alive for some anchor of the chunk.
    """
    alive = np.ones((len(anchor_x), len(rows_x)), bool)
    if anchor_x.shape[1] == 0:
        return alive
    columns = np.arange(len(rows_x))
    for left, right in zip(summaries(anchor_x), summaries(rows_x)):
        lower, upper = bounds(left, (right[0][columns], right[1][columns]))
        alive[:, columns] &= keep(lower, upper, alive[:, columns], columns)
        columns = columns[alive[:, columns].any(axis=0)]
        if not len(columns):
            break
    return alive


def exact(anchor_x: np.ndarray, rows_x: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact integer inner products of the given (anchor, row) pairs.

    Where survivors are dense (over a fraction ``DENSE`` of the chunk) one matrix product of the chunk with the rows
    that have a survivor is cheaper than products pair by pair; doubles hold it exactly while
    max|a| * max|x| * width stays below 2^53, else the pairs go one by one in 64-bit integers.
    """
    i, j = at
    width = anchor_x.shape[1]
    if len(i) > DENSE * len(anchor_x) * len(rows_x) and width:
        largest = float(np.abs(anchor_x).max(initial=0)) * float(np.abs(rows_x).max(initial=0)) * width
        if largest < 2.0 ** 53:
            used, where = np.unique(j, return_inverse=True)
            return (anchor_x @ rows_x[used].T)[i, where].astype(np.int64)
    out = np.zeros(len(i), np.int64)
    for low in range(0, len(i), 1 << 16):
        a, b = anchor_x[i[low:low + (1 << 16)]].astype(np.int64), rows_x[j[low:low + (1 << 16)]].astype(np.int64)
        out[low:low + (1 << 16)] = np.einsum("ij,ij->i", a, b)
    return out


def first(anchor: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k (score desc, id asc) entries of every anchor."""
    order = np.lexsort((ids, -scores, anchor))
    anchor = anchor[order]
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    place = np.arange(len(anchor)) - np.repeat(start, np.diff(np.r_[start, len(anchor)]))
    return order[place < k]


def positives_task(k: int, chunk: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "positive_id", "positive_score")})
        a_ids, a_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        r_ids, r_labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        ax, rx = matrix(anchors["x"], len(a_ids)), matrix(rows["x"], len(r_ids))
        found = []
        for low in range(0, len(a_ids), chunk):
            sl = slice(low, low + chunk)
            eligible = (a_labels[sl, None] == r_labels[None, :]) & (a_ids[sl, None] != r_ids[None, :])

            def keep(lower, upper, alive, columns, eligible=eligible):
                allowed = eligible[:, columns]
                return allowed & (upper >= kth(lower, allowed & alive, k)[:, None])

            i, j = np.nonzero(survivors(ax[sl], rx, keep))
            scores = exact(ax[sl], rx, (i, j))
            pick = first(i, r_ids[j], scores, k)
            found.append((a_ids[sl][i[pick]], r_ids[j[pick]], scores[pick]))
        anchor, ids, scores = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"anchor_id": pa.array(anchor, pa.int64()), "positive_id": pa.array(ids, pa.int64()),
                         "positive_score": pa.array(scores, pa.int64())})
    return run


def negatives_task(k: int, chunk: int):
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        r_ids, r_labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        rx = matrix(rows["x"], len(r_ids))
        # One entry per (anchor, positive): its band lo <= score <= hi from 30 p <= 100 s <= 90 p.
        pairs = anchors.select(["vec_id", "label", "positive_id", "positive_score"])
        a_ids, a_labels = pairs["vec_id"].to_numpy(), pairs["label"].to_numpy()
        p_ids, p_scores = pairs["positive_id"].to_numpy(), pairs["positive_score"].to_numpy()
        lo, hi = -((-30 * p_scores) // 100), (90 * p_scores) // 100
        ax = matrix(anchors["x"], len(a_ids))
        out = []
        for low in range(0, len(a_ids), chunk):
            sl = slice(low, low + chunk)
            eligible = (a_labels[sl, None] != r_labels[None, :]) & (lo[sl, None] <= hi[sl, None])

            def keep(lower, upper, alive, columns, eligible=eligible, sl=sl):
                reach = eligible[:, columns] & (upper >= lo[sl, None]) & (lower <= hi[sl, None])
                inside = reach & alive & (lower >= lo[sl, None]) & (upper <= hi[sl, None])
                return reach & (upper >= kth(lower, inside, k)[:, None])

            i, j = np.nonzero(survivors(ax[sl], rx, keep))
            scores = exact(ax[sl], rx, (i, j))
            band = (scores >= lo[sl][i]) & (scores <= hi[sl][i])
            i, j, scores = i[band], j[band], scores[band]
            pick = first(i, r_ids[j], scores, k)
            at = i[pick] + low
            out.append((a_ids[at], p_ids[at], p_scores[at], r_ids[j[pick]], scores[pick]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})
    return run


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, scale: float = 256.0, anchor_every: int = 100,
         shift_every: int = 7, rows_per_block: int = 8192, anchors_per_block: int = 2048, chunk: int = 256) -> DataFrame:
    """Hard negatives per anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding (array of numbers) and label; other columns are ignored. Rows with a null
    vec_id, label or vector, or any null or non-finite component take no part. Where vec_id is divisible by
    ``shift_every`` the label becomes (label + 1) % 10. Components become floor(scale * x) and a score is the integer
    inner product with the anchor; rows of another width than the anchor's are no candidates, and rows with the
    anchor's vec_id are its own. Anchors are rows with vec_id divisible by ``anchor_every`` (of repeated anchor ids the
    smallest (vector, label) counts); repeated other rows are candidates each. An anchor's positives are its first
    ``positives`` same-label rows by score (descending, then vec_id); for each, the first ``negatives`` rows of another
    label with 30 p <= 100 s <= 90 p follow, ranked from 1. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable = vectors.where(
        "vec_id is not null and label is not null and embedding is not null and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    ).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.expr(f"cast(case when vec_id % {shift_every} = 0 then pmod(label + 1, 10) else label end as long)").alias("label"),
        F.expr(f"transform(embedding, x -> floor({scale} * double(x)))").cast("array<double>").alias("x"),
    ).withColumn("width", F.size("x"))
    rows = staged(usable, "hardneg-rows")
    anchors = staged(
        rows.where(f"vec_id % {anchor_every} = 0").groupBy("vec_id")
        .agg(F.min(F.struct("x", "label", "width")).alias("a")).select("vec_id", "a.x", "a.label", "a.width"),
        "hardneg-anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    row_blocks, anchor_blocks = max(1, -(-n_rows // rows_per_block)), max(1, -(-n_anchors // anchors_per_block))

    def dealt_rows(frame: DataFrame) -> DataFrame:
        return frame.withColumn("rblock", F.expr(f"cast(pmod(xxhash64(vec_id, label), {row_blocks}) as int)")) \
            .withColumn("ablock", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))

    def dealt_anchors(frame: DataFrame) -> DataFrame:
        return frame.withColumn("ablock", F.expr(f"cast(pmod(xxhash64(vec_id), {anchor_blocks}) as int)")) \
            .withColumn("rblock", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    keys = ["width", "ablock", "rblock"]
    found = (
        dealt_anchors(anchors).groupBy(*keys).cogroup(dealt_rows(rows).groupBy(*keys))
        .applyInArrow(positives_task(positives, chunk), "anchor_id long, positive_id long, positive_score long")
        .withColumn("_r", F.expr("row_number() over (partition by anchor_id order by positive_score desc, positive_id)"))
        .where(f"_r <= {positives}").drop("_r")
    )
    found = staged(found, "hardneg-positives")
    asked = anchors.join(found.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    mined = (
        dealt_anchors(asked).groupBy(*keys).cogroup(dealt_rows(rows).groupBy(*keys))
        .applyInArrow(negatives_task(negatives, chunk),
                      "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        .withColumn("rank", F.expr(
            "cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as int)"))
        .where(f"rank <= {negatives}")
    )
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

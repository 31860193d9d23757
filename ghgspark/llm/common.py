"""What several operators share: staging, text columns as byte buffers, ragged gathers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(frame: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared scratch folder and read back: later steps start from these files,
    also after an executor is lost, and never compute it again."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    return max(1, math.ceil(rows / rows_per_bucket))


def gapless(frame: DataFrame, keys: list[str], order: list[str], name: str, rows_per_bucket: int = 16384) -> DataFrame:
    """Number the rows of every key from 0 without gaps in column ``name`` (long).

    A key may hold any share of the rows: rows are numbered inside (key, bucket) and each bucket starts after the
    counts of the buckets before it. Buckets come from the hash of ``order``, which must tell unequal rows apart.
    """
    rows = frame.count()
    buckets = buckets_for(rows, rows_per_bucket)
    salted = frame.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = (
        salted.groupBy(*keys, "_bucket").count()
        .selectExpr(*keys, "_bucket", f"sum(count) over (partition by {', '.join(keys)} order by _bucket) - count as _before")
    )
    inside = salted.selectExpr(
        "*", f"row_number() over (partition by {', '.join([*keys, '_bucket'])} order by {', '.join(order)}) - 1 as _inside")
    return (
        inside.join(before, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_before", "_inside")
    )


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in one buffer, and its n + 1 offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated slices [start, start + length)."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    shift, at = starts - (ends - lengths), np.arange(total, dtype=np.int64)
    at += np.repeat(shift, lengths)
    return at


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random odd 64-bit value per byte and the base of the polynomial over them.
BYTE_VALUES = np.random.default_rng(20240611).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[:] = np.uint64(BASE)
        out[0] = np.uint64(1)
        np.multiply.accumulate(out, out=out)
    return out


def segment_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice; the slices are adjacent and non-empty, the first begins at starts[0]."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low, high = int(starts[0]), int(starts[-1] + lengths[-1])
    place = np.arange(high - low, dtype=np.int32) - np.repeat((starts - low).astype(np.int32), lengths)
    values = BYTE_VALUES[data[low:high]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts - low) + lengths.astype(np.uint64))

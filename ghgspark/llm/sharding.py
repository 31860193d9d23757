"""Weighted rendezvous hashing of record keys over shards, by built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import gapless


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the key and the shard's name: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score -weight / ln(draw) is highest; ties go to the smaller shard.

    A shard's score does not depend on the others, so one more shard takes rows only into itself, and a changed
    weight moves rows only to or from that shard. A shard of weight 0 gets nothing.
    """
    scores = [
        F.struct((-F.lit(float(w)) / F.log(draw(key, i))).alias("score"), F.lit(-i).alias("shard"))
        for i, w in enumerate(weights) if w > 0
    ]
    if not scores:
        raise ValueError("some shard needs a weight above 0")
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def shard_records(records: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
                  grown_weight: float = 1.0, overhead: int = 8) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard (the shard once one of ``grown_weight`` is added).

    The key and the weights decide the shard alone. A null text has no bytes; null keys are one key. Repeated rows each
    get a slot. Slots are gapless from 0 in each shard and come from counts per (shard, bucket), so no shard's rows
    meet in one task. The text is not shuffled.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = records.select(
        F.col(key),
        (F.length(body) + overhead).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    return gapless(rows, ["shard"], [key, "size", "text_crc32"], "slot").select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")

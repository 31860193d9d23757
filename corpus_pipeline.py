"""Corpus pipeline: documents in, packed training sequences out. Every stage calls one operator of ``ghgspark.llm``.

Stages take (spark, docs, sf_dir) and work on all rows that the stage before kept. Each result is written as Parquet to
the shared scratch folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.llm.common import read_table, staged
from ghgspark.llm.neardup import near_duplicates
from ghgspark.llm.packing import pack_documents
from ghgspark.llm.quality import score_quality, train
from ghgspark.llm.queries import tokenizer
from ghgspark.llm.secrets import redact
from ghgspark.llm.suffixes import remove_repeats

#: A document is rejected below this score: the classifier's own boundary.
QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage classifier rejects go. It learns from the labels of documents that are not held out."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, ("_quality", "_predicted"))
    return scored.where(f"_quality >= {QUALITY}").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity 0.8) stays: its smallest doc_id's.

    Every (doc_id, text) takes part by itself, so rows with one doc_id and other texts stay if they are no near copies; of
    rows that repeat both one stays. Rows without an id all stay.
    """
    keyed = docs.where("doc_id is not null").withColumn("_near_key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    found = near_duplicates(keyed.select(F.col("_near_key").alias("doc_id"), "text")).selectExpr(
        "doc_id as _near_key", "component_id")
    kept = keyed.select("_near_key", "doc_id").distinct().join(found, "_near_key").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "_near_key")).alias("first")).selectExpr("first._near_key as _near_key")
    named = keyed.join(kept, "_near_key", "left_semi").selectExpr(
        "*", "row_number() over (partition by _near_key order by text) as _near_copy").where("_near_copy = 1")
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document with a smaller id has too are taken out of the text."""
    return remove_repeats(docs).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mask."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The classifier cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

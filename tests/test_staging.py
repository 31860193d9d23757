"""Staged texts and the test for unusual white space."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ghgspark.functions import has_wide_space
from ghgspark.functions.text import WHITE_SPACE
from ghgspark.plans import adapters as A


def test_staged_texts_are_packed_tightly(spark):
    staged = A.staged(spark, "nowhere", "test-staged", lambda: spark.range(50).selectExpr("id", "concat('text ', id) as text"))
    files = [file.removeprefix("file://") for file in staged.inputFiles()]
    chunks = [pq.ParquetFile(Path(file)).metadata.row_group(0).column(1) for file in files]
    assert {chunk.compression for chunk in chunks} == {"ZSTD"} and staged.count() == 50


def test_only_what_is_not_ascii_is_searched_for_each_wide_space(spark):
    texts = [None, "", "plain \t\r\n text", "Währung – ä€", "﻿", "😀"] + [f"ä{space}x" for space in WHITE_SPACE] + list(WHITE_SPACE)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", has_wide_space(F.col("text")).alias("wide"))
    assert [r["wide"] for r in frame.collect()] == [
        None if t is None else any(c in t for c in WHITE_SPACE[6:]) for t in texts]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(text#") == 4

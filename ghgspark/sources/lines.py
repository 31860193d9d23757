"""Text files as lines frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.session import scratch_path


def read_lines(spark: SparkSession, path: str, pattern: str = "*.csv", staging: str | None = None) -> DataFrame:
    """Lines of the files in a folder, staged once as Parquet.

    How Spark cuts files into blocks may differ between two reads of the same folder (it
    depends on the cores at hand), while profiling and parsing must agree on the blocks. The
    staged table fixes them, survives lost executors and is columnar for the later passes.
    """
    staging = staging or scratch_path(spark, "lines")
    (
        spark.read.option("pathGlobFilter", pattern)
        .text(path)
        .select(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            "value",
        )
        .write.parquet(staging)
    )
    return spark.read.parquet(staging)

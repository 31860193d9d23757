"""Input folders: listing, admission checks and file hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "file STRING, kind STRING, length BIGINT"


def _file_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """``file, kind, length`` of a folder's documents and exports, by name, not recursive.

    Only metadata is read, never content. Spark's file scans leave out files without a byte; to
    report those, pass the expected names to :func:`admit` as ``requested``.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{pdf,csv}")
        .load(folder)
        .select(
            _file_name(F.col("path")).alias("file"),
            F.regexp_extract("path", r"\.([^.]+)$", 1).alias("kind"),
            "length",
        )
        .orderBy("kind", "file")
    )


def admit(listing: DataFrame, requested: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """``file, kind, length, admitted, error`` for listed and, if given, requested files.

    Documents must be non-empty; an empty export has no rows but is no error. Documents of any size are admitted
    unless a caller sets ``max_bytes``; larger ones then get an error.
    """
    is_document = F.col("kind") == "pdf"
    error = F.when(
        is_document & (F.col("length") == 0), F.concat(F.lit("Empty file: "), F.col("file"))
    )
    if max_bytes is not None:
        error = error.when(
            is_document & (F.col("length") > max_bytes),
            F.concat(F.lit(f"File too large (>{max_bytes // 1_000_000} MB): "), F.col("file")),
        )
    checked = listing.withColumn("error", error).withColumn(
        "admitted", F.col("error").isNull() & (F.col("length") > 0)
    ).select("file", "kind", "length", "admitted", "error")
    if requested is None:
        return checked
    missing = requested.select("file").join(listing, "file", "left_anti").select(
        "file",
        F.regexp_extract("file", r"\.([^.]+)$", 1).alias("kind"),
        F.lit(None).cast("bigint").alias("length"),
        F.lit(False).alias("admitted"),
        F.concat(F.lit("File not found: "), F.col("file")).alias("error"),
    )
    return checked.unionByName(missing)


def account(listing: DataFrame, documents: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """:func:`admit` for a listing and the extracted ``documents`` (``filename, text``), with nothing left out.

    Besides the admission checks, a document file without any extracted text (no row, null or blank) is an error, and
    so is a row whose file is not listed (missing, or without a byte, which Spark's listing leaves out).
    """
    names = documents.select(F.col("filename").alias("file")).distinct()
    checked = admit(listing, names, max_bytes)
    readable = documents.where(F.trim(F.regexp_replace("text", r"(?U)\s", "")) != "").select(
        F.col("filename").alias("file"), F.lit(True).alias("_readable")).distinct()
    lacking = (F.col("kind") == "pdf") & F.col("admitted") & F.col("_readable").isNull()
    return checked.join(readable, "file", "left").select(
        "file", "kind", "length",
        (F.col("admitted") & ~lacking).alias("admitted"),
        F.when(lacking, F.lit("No text extracted from PDF")).otherwise(F.col("error")).alias("error"),
    )


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``file, file_hash``: SHA-256 of each file's bytes."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(_file_name(F.col("path")).alias("file"), F.sha2("content", 256).alias("file_hash"))
    )

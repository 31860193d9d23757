"""Energy records and errors as CSV (and any other format Spark writes)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.functions import fixed_text, to_double
from ghgspark.operators.report import has_required_columns
from ghgspark.schemas import RECORD_COLUMNS
from ghgspark.session import scratch_path

_CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "multiLine": False}


def _escaped(c: Column) -> Column:
    """Line ends as two characters each, so that every record is one line and the files can be cut anywhere."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _unescaped(c: Column) -> Column:
    # Parts of a doubled backslash are put back last, so that they do not start another pair.
    parts = F.transform(
        F.split(c, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
    )
    return F.array_join(parts, "\\")


def as_csv_columns(records: DataFrame) -> DataFrame:
    """Record columns as written: no ``content``, numbers with four decimals."""
    columns = []
    for name, kind in RECORD_COLUMNS.items():
        if name != "content":
            columns.append((fixed_text(F.col(name), 4) if kind == "double" else _escaped(F.col(name))).alias(name))
    return records.select(*columns)


def _write_unless_empty(rows: DataFrame, path: str) -> bool:
    spark = rows.sparkSession
    staging = scratch_path(spark, "csv")
    rows.write.parquet(staging)
    stored = spark.read.schema(rows.schema).parquet(staging)
    if stored.isEmpty():
        return False
    stored.write.mode("overwrite").options(**_CSV).csv(path)
    return True


def write_records_csv(records: DataFrame, path: str) -> bool:
    """Write the records; False, and nothing written, when there are none. The plan runs once."""
    return _write_unless_empty(as_csv_columns(records), path)


def write_errors_csv(errors: DataFrame, path: str) -> bool:
    """Write the error rows; False, and nothing written, when there are none. The plan runs once."""
    return _write_unless_empty(errors.select(*[_escaped(F.col(c)).alias(c) for c in errors.columns]), path)


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records back from CSV, columns found by name and numbers typed.

    Raises for a missing path, for missing required columns and for a table without rows.
    """
    try:
        raw = spark.read.options(**_CSV).csv(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"No data found at {path}.") from exc
    has_required_columns(raw)
    if raw.isEmpty():
        raise ValueError("CSV contains no records.")
    return raw.select(
        *[
            (to_double(F.col(c)) if RECORD_COLUMNS.get(c) == "double" else _unescaped(F.col(c))).alias(c)
            for c in raw.columns
        ]
    )


def copy_records(spark: SparkSession, source: str, target: str, fmt: str = "csv") -> None:
    """Copy the record CSV to another path, optionally in another format."""
    records = read_records_csv(spark, source)
    if fmt == "csv":
        as_csv_columns(records).write.mode("overwrite").options(**_CSV).csv(target)
    else:
        records.write.mode("overwrite").format(fmt).save(target)

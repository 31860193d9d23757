"""Delimited energy exports to parsed documents."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ghgspark.constants import DEFAULT_CURRENCY, DELIMITERS, EXPORT_VENDOR
from ghgspark.functions import (
    blank_to_null,
    export_energy_type,
    locale_number,
    normalize_period,
    or_default,
    strip,
    to_base_unit,
    unit_name,
)
from ghgspark.operators import profile
from ghgspark.schemas import LINE_ITEM


def _cell(field: str) -> Column:
    """Trimmed cell of a field, '' where the field or the cell is missing."""
    return strip(F.coalesce(F.get("cells", F.col(f"columns.{field}")), F.lit("")))


def _is_row() -> Column:
    """True unless the line is blank under its file's delimiter."""
    return reduce(
        lambda case, d: case.when(F.col("delimiter") == d, profile.has_cell_text(F.col("value"), d)),
        DELIMITERS, F,
    )


def _with_cells(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("text", profile.decode_line(F.col("value"), F.col("encoding")))
        .withColumn("cells", profile.split_cells(F.col("text"), F.col("delimiter")))
        .withColumn("is_short", F.size("cells") < F.coalesce(F.col("min_cells"), F.lit(0)))
    )


def numbered_rows(lines: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Data rows with their cells and 1-based ``row_number`` in the file.

    Blank rows and the header are not counted, short rows are. Rows are numbered inside their
    block and shifted by the count of the blocks before, so one huge file spreads over as many
    tasks as it has blocks and the lines are shuffled once, by (file, block).
    """
    plan = profile.block_offsets(blocks, files.where(F.col("error").isNull()))
    in_block = F.row_number().over(W.partitionBy("file", "block").orderBy("pos"))
    numbered = (
        lines.join(plan, ["file", "block"])
        .where(_is_row())
        .withColumn("row_number", F.col("rows_before") + in_block - F.col("has_header").cast("int"))
        .where(F.col("row_number") > 0)
    )
    return _with_cells(numbered).drop("value", "text", "rows_before")


def short_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``file, skipped_rows`` of the files with data rows.

    Rows are counted where they are read, without numbers. A header row is never short, as its own cells tell how many a
    row needs, so it is only left out of the count that tells whether there is data.
    """
    rows = lines.where(F.col("block").isNotNull()).join(
        files.where(F.col("error").isNull()).select("file", "encoding", "delimiter", "has_header", "min_cells"), "file"
    ).where(_is_row())
    counted = _with_cells(rows).groupBy("file").agg(
        F.count_if("is_short").alias("skipped_rows"), (F.count("*") - F.max(F.col("has_header").cast("int"))).alias("data"))
    return counted.where(F.col("data") > 0).drop("data")


def parse_rows(rows: DataFrame, strict_locale: bool = False) -> DataFrame:
    """Numbered rows to parsed documents, one per row that is not short."""
    raw = {f: _cell(f).alias(f"{f}_raw") for f in ("site", "period", "energy_type", "energy_amount", "unit",
                                                   "total_eur", "currency", "meter_id")}
    cells = rows.where(~F.col("is_short")).select("file", "row_number", "number_format", "cells", *raw.values())

    def number(field: str) -> Column:
        return locale_number(F.col(f"{field}_raw"), F.col("number_format"), strict_locale)

    values = cells.select(
        "*",
        normalize_period(F.col("period_raw")).alias("period"),
        export_energy_type(F.col("energy_type_raw")).alias("energy_type"),
        number("energy_amount").alias("energy_amount"),
        number("total_eur").alias("total_eur"),
        unit_name(F.col("unit_raw")).alias("unit"),
        F.concat("file", F.lit(":row_"), F.col("row_number").cast("string")).alias("blob_name"),
    )

    def unparsed(what: str, value: str, raw_cell: str) -> Column:
        return F.when(
            F.col(value).isNull() & (F.col(raw_cell) != ""),
            F.concat(F.lit(f"Could not parse {what}: '"), F.col(raw_cell), F.lit("'")),
        )

    text = F.lit(None).cast("string")
    amount = F.lit(None).cast("double")
    return values.select(
        F.col("file").alias("filename"),
        text.alias("file_hash"),
        F.array_join("cells", ";").alias("raw_text"),
        F.lit(EXPORT_VENDOR).alias("vendor_name"),
        text.alias("customer_name"),
        blank_to_null(F.col("site_raw")).alias("site_address"),
        text.alias("address"),
        F.concat(
            F.lit("SAP-"), F.regexp_replace("file", r"(?<=.)\.[^.]+$", ""),
            F.lit("-R"), F.col("row_number").cast("string"),
        ).alias("invoice_number"),
        text.alias("invoice_date"),
        or_default(F.col("currency_raw"), DEFAULT_CURRENCY).alias("currency"),
        F.col("period").alias("billing_period_from"),
        F.col("period").alias("billing_period_to"),
        F.array(
            F.struct(
                blank_to_null(F.col("meter_id_raw")).alias("meter_id"),
                "energy_type",
                F.col("period").alias("period_from"),
                F.col("period").alias("period_to"),
                to_base_unit(F.col("energy_amount"), F.col("unit")).alias("consumption_kwh"),
                amount.alias("unit_price"),
                F.col("total_eur").alias("amount_eur"),
                F.col("unit").alias("consumption_unit"),
            ).cast(LINE_ITEM)
        ).alias("line_items"),
        amount.alias("subtotal"),
        amount.alias("network_levies"),
        amount.alias("vat_amount"),
        F.col("total_eur").alias("total_amount"),
        "blob_name",
        F.sha2("blob_name", 256).alias("row_hash"),
        F.lit(True).alias("success"),
        text.alias("error"),
        F.array_compact(
            F.array(
                unparsed("period", "period", "period_raw"),
                unparsed("consumption", "energy_amount", "energy_amount_raw"),
                unparsed("cost", "total_eur", "total_eur_raw"),
            )
        ).alias("warnings"),
        "row_number",
    )


class Export:
    """A lines frame with its profiles; every view below shares them."""

    def __init__(self, lines: DataFrame, sample: bool = False):
        self.lines = lines
        # Small next to the lines: a few numbers per block, used by three steps.
        self.blocks = profile.block_profile(lines).persist(StorageLevel.MEMORY_AND_DISK)
        self.files = profile.file_profile(lines, self.blocks, sample)

    def rows(self) -> DataFrame:
        return numbered_rows(self.lines, self.blocks, self.files)

    def documents(self, strict_locale: bool = False) -> DataFrame:
        return parse_rows(self.rows(), strict_locale)

    def file_errors(self) -> DataFrame:
        """``filename, message`` of the files whose columns cannot be told."""
        return self.files.where(F.col("error").isNotNull()).select(
            F.col("file").alias("filename"), F.col("error").alias("message")
        )

    def skipped_rows(self) -> DataFrame:
        """``file, skipped_rows``: data rows with too few cells."""
        return short_rows(self.lines, self.files)

    def release(self) -> None:
        self.blocks.unpersist()


def parse_exports(lines: DataFrame, strict_locale: bool = False) -> DataFrame:
    """Parsed documents of every readable file of a lines frame."""
    return Export(lines).documents(strict_locale)

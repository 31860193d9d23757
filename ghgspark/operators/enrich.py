"""Parsed documents and line items to energy records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ghgspark.constants import DEFAULT_CURRENCY, DEFAULT_UNIT
from ghgspark.functions import blank_to_null, exact_sum, fixed_text, float_text, number_or_default, or_default
from ghgspark.schemas import RECORD_COLUMNS


def record_content(
    filename: Column, site: Column, period_from: Column, period_to: Column, energy_type: Column,
    amount: Column, unit: Column, total: Column, currency: Column,
) -> Column:
    """One-sentence-per-fact summary of a record, the text that gets indexed."""

    def period(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    return F.concat(
        F.lit("Invoice "), filename,
        F.lit(" for site "), or_default(site, "unknown"),
        F.lit(" covers period "), period(period_from), F.lit(" to "), period(period_to),
        F.lit(" for "), or_default(energy_type, "unknown"),
        F.lit(" energy. Energy amount is "), float_text(amount), F.lit(" "), unit,
        F.lit(". Total cost is "), number_or_default(total, "unknown"),
        F.lit(" "), or_default(currency, DEFAULT_CURRENCY), F.lit("."),
    )


def with_factor(frame: DataFrame, factors: DataFrame) -> DataFrame:
    """Add ``emission_factor_value`` and ``emission_factor_source`` by energy type.

    A left join on the factor dimension; Catalyst broadcasts it while its size allows.
    """
    dimension = factors.where(F.col("energy_type").isNotNull()).select(
        "energy_type",
        F.col("value").alias("emission_factor_value"),
        F.col("source").alias("emission_factor_source"),
    )
    return frame.join(dimension, "energy_type", "left")


def emissions(consumption: Column, factor: Column) -> Column:
    """Consumption times factor; null without a factor and for zero consumption."""
    return F.when(factor.isNotNull() & (consumption != 0), consumption * factor)


def _as_records(frame: DataFrame) -> DataFrame:
    frame = frame.withColumn(
        "content",
        record_content(
            F.col("filename"), F.col("site"), F.col("billing_period_from"), F.col("billing_period_to"),
            F.col("energy_type"), F.col("consumption_kwh"), F.col("consumption_unit"),
            F.col("total_eur"), F.col("currency"),
        ),
    )
    return frame.select(*[F.col(name).cast(kind) for name, kind in RECORD_COLUMNS.items()])


def build_records(parsed: DataFrame, factors: DataFrame) -> DataFrame:
    """Energy records of the successful parsed documents.

    A document's items are totalled inside its row; type and unit come from the first item
    that has one, so the first item's factor applies to the whole document.
    """
    items = F.coalesce("line_items", F.array())

    def first(field: str) -> Column:
        return F.get(F.filter(F.transform(items, lambda i: blank_to_null(i[field])), lambda v: v.isNotNull()), 0)

    totals = parsed.where("success").select(
        "filename",
        F.coalesce("row_hash", "file_hash").alias("pdf_hash"),
        "vendor_name",
        "customer_name",
        F.col("site_address").alias("site"),
        "invoice_number",
        "invoice_date",
        "billing_period_from",
        "billing_period_to",
        first("energy_type").alias("energy_type"),
        F.aggregate(
            items, F.lit(0.0), lambda total, i: total + F.coalesce(i["consumption_kwh"], F.lit(0.0))
        ).alias("consumption_kwh"),
        F.coalesce(first("consumption_unit"), F.lit(DEFAULT_UNIT)).alias("consumption_unit"),
        F.col("total_amount").alias("total_eur"),
        or_default(F.col("currency"), DEFAULT_CURRENCY).alias("currency"),
    )
    enriched = with_factor(totals, factors).withColumn(
        "emissions_tco2", emissions(F.col("consumption_kwh"), F.col("emission_factor_value"))
    )
    return _as_records(enriched)


def line_totals(
    lines: DataFrame, key: str, order: list[str], factors: DataFrame, per_line: bool = False
) -> DataFrame:
    """Totals per document from flat line items (one row each).

    ``lines`` needs ``key``, the ``order`` columns, ``energy_type``, ``consumption_unit``,
    ``consumption_kwh`` and ``amount_eur``. Sums and firsts all combine on the map side, so
    a document with very many lines costs no more than its partial results. With ``per_line``
    every line uses the factor of its own type instead of the first line's.
    """
    position = F.struct(*order)

    def first(name: str) -> Column:
        value = blank_to_null(F.col(name))
        return F.min_by(value, F.when(value.isNotNull(), position))

    measures = [
        F.sum(F.coalesce("consumption_kwh", F.lit(0.0))).alias("consumption_kwh"),
        first("energy_type").alias("energy_type"),
        F.coalesce(first("consumption_unit"), F.lit(DEFAULT_UNIT)).alias("consumption_unit"),
        exact_sum(F.col("amount_eur"), 4).alias("total_eur"),
    ]
    if not per_line:
        return with_factor(lines.groupBy(key).agg(*measures), factors).withColumn(
            "emissions_tco2", emissions(F.col("consumption_kwh"), F.col("emission_factor_value"))
        )
    own = with_factor(lines, factors)
    product = emissions(F.coalesce("consumption_kwh", F.lit(0.0)), F.col("emission_factor_value"))
    return own.groupBy(key).agg(
        *measures, exact_sum(product).alias("emissions_tco2")
    )


def records_from_lines(lines: DataFrame, headers: DataFrame, key: str, order: list[str], factors: DataFrame,
                       named: Callable[[DataFrame], DataFrame] = lambda joined: joined) -> DataFrame:
    """Energy records from flat line items and a headers frame keyed by ``key``.

    Headers without lines give records with zero consumption. ``named`` adds record columns to the joined rows, so that
    texts made of a header's columns are not shuffled with it.
    """
    totals = line_totals(lines, key, order, factors)
    return _as_records(
        named(headers.join(totals, key, "left"))
        .withColumn("consumption_kwh", F.coalesce("consumption_kwh", F.lit(0.0)))
        .withColumn("consumption_unit", F.coalesce("consumption_unit", F.lit(DEFAULT_UNIT)))
        .withColumn("currency", or_default(F.col("currency"), DEFAULT_CURRENCY))
    )


def union_records(*frames: DataFrame) -> DataFrame:
    """One record stream from several source kinds."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def parse_errors(parsed: DataFrame, error_type: str = "parse_error") -> DataFrame:
    """Error rows of the parsed documents that failed."""
    return error_rows(
        parsed.where(~F.col("success")).select("filename", F.col("error").alias("message")), error_type
    )


def error_rows(failures: DataFrame, error_type: str) -> DataFrame:
    """``filename, message`` rows as error rows, stamped with the query's UTC time."""
    return failures.select(
        "filename",
        F.lit(error_type).alias("error_type"),
        F.coalesce("message", F.lit("Unknown parse error")).alias("message"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
    )


def record_summary(records: DataFrame) -> DataFrame:
    """Short printable view of each record, numbers kept beside their text."""
    return records.select(
        "filename",
        or_default(F.col("energy_type"), "?").alias("energy_type"),
        "consumption_kwh",
        F.format_number(F.rint("consumption_kwh"), 0).alias("consumption_text"),
        "consumption_unit",
        number_or_default(F.col("total_eur"), "?").alias("total_text"),
        "emissions_tco2",
        F.coalesce(
            F.concat(fixed_text(F.col("emissions_tco2"), 3), F.lit(" tCO2e")), F.lit("n/a")
        ).alias("emissions_text"),
    )


def run_counters(
    listing: DataFrame, records: DataFrame, errors: DataFrame, skipped: DataFrame | None = None
) -> DataFrame:
    """One row: files by kind, records, failures and, if given, skipped export rows.

    ``total_files`` counts documents only; ``skipped`` has ``skipped_rows`` per file.
    """
    files = listing.agg(
        F.count_if(F.col("kind") == "pdf").alias("pdf_files"), F.count_if(F.col("kind") == "csv").alias("csv_files")
    )
    good = records.agg(F.count("*").alias("successful"))
    bad = errors.agg(F.count("*").alias("failed"))
    one = F.lit(1).alias("one")
    # One-row frames side by side.
    counters = (
        files.select(one, F.col("pdf_files").alias("total_files"), "pdf_files", "csv_files")
        .join(good.select(one, "successful"), "one")
        .join(bad.select(one, "failed"), "one")
    )
    if skipped is not None:
        total = skipped.agg(F.coalesce(F.sum("skipped_rows"), F.lit(0)).alias("skipped_rows"))
        counters = counters.join(total.select(one, "skipped_rows"), "one")
    return counters.drop("one")

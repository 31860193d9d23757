"""The TPC-H-like tables seen as energy data: billing lines, exports, invoices, records.

Every adapter covers its whole tables. Rendering is row by row; only sums per order (which
combine on the map side) and joins on keys move rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.functions import invoice_energy_type
from ghgspark.operators.enrich import emissions, records_from_lines, with_factor
from ghgspark.operators.index import index_documents
from ghgspark.session import scratch_path
from ghgspark.sources.factors import default_factors

# Invoice labels and export labels by p_type.
INVOICE_LABEL = """CASE p_type WHEN 'ECONOMY' THEN 'Strom - Produktion' WHEN 'LARGE' THEN 'Electricity'
 WHEN 'STANDARD' THEN 'Erdgas Kessel' WHEN 'PROMO' THEN 'Diesel - Internal logistics'
 WHEN 'SMALL' THEN 'Fernwaerme' ELSE 'Dampf' END"""
EXPORT_LABEL = """CASE p_type WHEN 'ECONOMY' THEN 'Strom' WHEN 'LARGE' THEN 'Electricity'
 WHEN 'STANDARD' THEN 'Erdgas' WHEN 'PROMO' THEN 'Diesel'
 WHEN 'SMALL' THEN 'Fernwaerme' ELSE 'Dampf' END"""

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
BLOCK_ORDERS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; its footer is read once per session."""
    known = spark.__dict__.setdefault("_ghgspark_tables", {})
    path = f"{sf_dir}/{name}.parquet"
    if path not in known:
        known[path] = spark.read.parquet(path)
    return known[path]


def staged(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived input written once per session below the shared scratch folder.

    Rendered texts stand for files and index rows for a stored index: both are data at rest for
    the operators, so they are scanned as tables instead of being rendered anew in every pass
    (and rendering expressions stay out of the plans under test).
    """
    known = spark.__dict__.setdefault("_ghgspark_staged", {})
    if (label, sf_dir) not in known:
        path = scratch_path(spark, label)
        # Texts are most of the scratch folder; zstd takes about half of what the default codec does.
        build().write.parquet(path, compression="zstd")
        known[label, sf_dir] = spark.read.parquet(path)
    return known[label, sf_dir]


def spread(frame: DataFrame, *keys: str | Column) -> DataFrame:
    """Deal the rows of a small file over the cores: rendering and parsing follow the pieces of the scan."""
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism, *keys)


def spread_scan(frame: DataFrame, *keys: str) -> DataFrame:
    """A table's scan, dealt anew only where it has fewer pieces than there are cores."""
    if frame.rdd.getNumPartitions() >= frame.sparkSession.sparkContext.defaultParallelism:
        return frame
    return spread(frame, *keys)


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's name and nation."""
    return (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"),
              F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
              F.col("c_nationkey") == F.col("n_nationkey"))
    )


def billing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: ``invoice_id``, order columns, raw label, type, consumption, amount."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("invoice_id"),
            *LINE_ORDER,
            F.expr(INVOICE_LABEL).alias("raw_label"),
            F.col("l_quantity").alias("consumption_kwh"),
            F.col("l_extendedprice").alias("amount_eur"),
        )
        .withColumn("energy_type", invoice_energy_type(F.col("raw_label")))
        .withColumn("consumption_unit", F.expr("CASE WHEN energy_type = 'diesel' THEN 'litres' ELSE 'kWh' END"))
    )


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every billing line as a record of its own, with site, month, type and emissions."""
    headers = order_headers(spark, sf_dir).select(
        "o_orderkey", F.col("n_name").alias("site"), F.date_format("o_orderdate", "yyyy-MM").alias("billing_period_from")
    )
    lines = billing_lines(spark, sf_dir).select("invoice_id", "energy_type", "consumption_kwh")
    return (
        with_factor(lines, default_factors(spark))
        .withColumn("emissions_tco2", emissions(F.col("consumption_kwh"), F.col("emission_factor_value")))
        .join(headers, F.col("invoice_id") == F.col("o_orderkey"))
        .select("site", "billing_period_from", F.col("billing_period_from").alias("billing_period_to"),
                "energy_type", "consumption_kwh", "emissions_tco2")
    )


def _billed_orders(
    spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame], DataFrame] = lambda records: records
) -> DataFrame:
    """Energy records, one per order. ``deal`` is given the joined rows before their texts are written out."""

    def named(joined: DataFrame) -> DataFrame:
        # Only what the texts are made of goes through the joins' shuffles.
        month = F.date_format("o_orderdate", "yyyy-MM")
        joined = deal(joined.withColumn("filename", F.concat(F.lit("INV-"), F.col("invoice_id").cast("string"), F.lit(".pdf"))))
        return joined.select(
            "*",
            F.sha2("filename", 256).alias("pdf_hash"),
            F.lit("Grid Supply AG").alias("vendor_name"),
            F.col("c_name").alias("customer_name"),
            F.col("n_name").alias("site"),
            F.concat(F.lit("R-"), F.col("invoice_id").cast("string")).alias("invoice_number"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"),
            month.alias("billing_period_from"),
            month.alias("billing_period_to"),
            F.lit(None).cast("string").alias("currency"),
        )

    headers = order_headers(spark, sf_dir).select(F.col("o_orderkey").alias("invoice_id"), "c_name", "n_name", "o_orderdate")
    return records_from_lines(
        billing_lines(spark, sf_dir), headers, "invoice_id", LINE_ORDER, default_factors(spark), named
    )


def invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy records, one per order; orders without lines give records without consumption."""
    return _billed_orders(spark, sf_dir)


# --- delimited exports -----------------------------------------------------------------

_PERIOD_SHAPES = """CASE {n}
 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 1 THEN date_format(o_orderdate, 'MM.yyyy')
 WHEN 2 THEN date_format(o_orderdate, 'yyyyMM') WHEN 3 THEN date_format(o_orderdate, "'P'MM/yyyy")
 WHEN 4 THEN date_format(o_orderdate, 'MM/yyyy')
 WHEN 5 THEN concat(element_at(array('Januar','Februar','März','April','Mai','Juni','Juli','August',
   'September','Oktober','November','Dezember'), month(o_orderdate)), ' ', year(o_orderdate))
 WHEN 6 THEN concat(element_at(array('January','February','March','April','May','June','July','August',
   'September','October','November','December'), month(o_orderdate)), ' ', year(o_orderdate))
 ELSE concat(' ', date_format(o_orderdate, 'yyyy-MM'), ' ') END"""


def period_text(n: str) -> str:
    """SQL for an order's month in one of eight shapes."""
    return _PERIOD_SHAPES.format(n=n)


def _render(columns: list[str]) -> str:
    return f"concat_ws(delimiter, {', '.join(columns)})"


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals with the layout of the export file (one per nation) they belong to."""
    first = F.min_by(F.col("p_type"), F.struct(*LINE_ORDER))
    totals = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("cost"),
            first.alias("p_type"),
        )
    )
    return _layout(
        order_headers(spark, sf_dir).join(totals, F.col("o_orderkey") == F.col("l_orderkey"))
    )


def _layout(frame: DataFrame) -> DataFrame:
    return frame.select(
        "*",
        F.expr("concat('export_', lower(n_name), '.csv')").alias("file"),
        F.expr("element_at(array(';', ',', '\\t'), n_nationkey % 3 + 1)").alias("delimiter"),
        F.expr("n_nationkey % 3 = 1 OR n_nationkey % 2 = 1").alias("english"),
        F.expr("n_nationkey % 5 <> 4").alias("has_header"),
        F.expr("n_nationkey % 4 = 1").alias("single_byte"),
    )


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "export-lines", lambda: _export_lines(spark, sf_dir))


def _export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines frame of the exports: quoted cells, blank rows, short rows, two encodings.

    A block holds the orders of one stretch of keys, so it stays small however large its file is.
    """
    number = "CASE WHEN english THEN string({0}) ELSE replace(string({0}), '.', ',') END"
    rows = export_rows(spark, sf_dir).select(
        "*",
        F.expr(f"CASE WHEN has_header THEN {period_text('o_orderkey % 8')} "
               f"ELSE {period_text('o_orderkey % 4')} END").alias("period_cell"),
        F.expr(f"CASE WHEN NOT has_header AND p_type = 'MEDIUM' THEN 'Fernwaerme' ELSE {EXPORT_LABEL} END").alias("label"),
        F.expr("""CASE WHEN p_type IN ('ECONOMY', 'LARGE') AND o_orderkey % 3 = 0 THEN 'MWh'
          WHEN p_type = 'STANDARD' AND o_orderkey % 3 = 1 THEN 'm3' WHEN p_type = 'PROMO' THEN 'Liter'
          ELSE 'kWh' END""").alias("unit"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN concat('\"Hauptzähler', delimiter, ' \"\"Nord\"\"\"') "
               "ELSE 'Hauptzähler Süd' END").alias("remark"),
        F.expr(number.format("amount")).alias("amount_cell"),
        F.expr(number.format("cost")).alias("cost_cell"),
    )
    full = _render(["n_name", "period_cell", "label", "amount_cell", "unit", "cost_cell", "'EUR'",
                    "concat('M-', o_orderkey)", "remark"])
    short = _render(["n_name", "period_cell", "label", "amount_cell"])
    blank = "repeat(delimiter, 8)"
    body = rows.select(
        "file", "single_byte",
        F.expr(f"o_orderkey div {BLOCK_ORDERS}").cast("bigint").alias("block"),
        "o_orderkey",
        F.posexplode(F.expr(
            f"filter(array(CASE WHEN o_orderkey % 13 = 0 THEN {blank} END, "
            f"CASE WHEN has_header AND o_orderkey % 17 = 0 THEN {short} ELSE {full} END), x -> x IS NOT NULL)"
        )).alias("n", "text"),
    ).select("file", "single_byte", "block", (F.col("o_orderkey") * 2 + F.col("n")).alias("pos"), "text")
    german = _render(["'Werk'", "'Zeitraum'", "'Energieart'", "'Verbrauch'", "'Einheit'", "'Kosten'", "'Währung'",
                      "'Zähler_ID'", "'Bemerkung'"])
    english = _render(["'Plant'", "'Month'", "'Energy_Source'", "'Quantity'", "'Unit'", "'Cost'", "'Currency'",
                       "'Meter'", "'Remarks'"])
    headers = _layout(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).where("has_header").select(
        "file", "single_byte", F.lit(0).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
        F.expr(f"CASE WHEN english THEN {english} ELSE {german} END").alias("text"),
    )
    return body.unionByName(headers).select(
        "file", "block", "pos",
        F.expr("CASE WHEN single_byte THEN string(encode(text, 'ISO-8859-1')) ELSE text END").alias("value"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, odd ones in a single-byte encoding where their text allows it."""
    lines = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("file"),
        F.expr("doc_id % 2 = 1 AND NOT text rlike '[^\\\\x00-\\\\xff]'").alias("single_byte"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    return lines.select(
        "file",
        F.expr(f"pos div {BLOCK_ORDERS}").cast("bigint").alias("block"),
        F.col("pos").cast("bigint").alias("pos"),
        F.expr("CASE WHEN single_byte THEN string(encode(line, 'ISO-8859-1')) ELSE line END").alias("value"),
    )


# --- invoices ------------------------------------------------------------------------------

def invoice_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values printed on the invoice of each line item (two billed items per invoice)."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    lines = spread_scan(table(spark, sf_dir, "lineitem").select(*columns), "l_orderkey", "l_linenumber").join(
        table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey")
    )
    facts = lines.join(order_headers(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return facts.select(
        "o_orderkey", "l_suppkey", "l_partkey", "o_custkey", "c_name", "n_name", "o_orderdate",
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("doc_id"),
        F.expr("o_orderkey % 2 = 0").alias("english"),
        F.expr("o_orderkey % 3 = 0").alias("has_table"),
        F.expr(INVOICE_LABEL).alias("label"),
        F.expr("bigint(l_quantity) * 100").alias("consumption"),
        F.expr("cast(l_extendedprice as decimal(18,2))").alias("amount"),
        F.expr("bigint(p_size)").alias("heat"),
        F.expr("cast(p_size * 0.5 as decimal(18,2))").alias("heat_amount"),
        F.expr("cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(18,2))").alias("levies"),
        F.expr("cast(cast(l_extendedprice as decimal(18,2)) * 0.19 as decimal(18,2))").alias("vat"),
        F.expr("trunc(o_orderdate, 'MM')").alias("first_day"),
        F.expr("last_day(o_orderdate)").alias("last_day"),
    )


def invoice_documents(spark: SparkSession, sf_dir: str, tables: str = "has_table") -> DataFrame:
    return staged(
        spark, sf_dir, f"invoices-{tables}", lambda: _invoice_documents(spark, sf_dir, tables)
    )


def _invoice_documents(spark: SparkSession, sf_dir: str, tables: str) -> DataFrame:
    """Documents frame of the invoices; ``tables`` is the SQL condition for printing a cell table."""
    iso, german = "'yyyy-MM-dd'", "'dd.MM.yyyy'"

    def line(n: int, meter: str, label: str, amount: str, price: str, total: str) -> str:
        return (
            f"concat_ws(' ', '{n}', {meter}, {label}, date_format(first_day, {iso}), date_format(last_day, {iso}), "
            f"format_number({amount}, 0), '{price}', format_number({total}, 2))"
        )

    items = [
        ("concat('M-', l_partkey, '-A')", "label", "consumption", "0.1810", "amount"),
        ("concat('H-', l_partkey, '-B')", "'Fernwaerme Umlage'", "heat", "0.5000", "heat_amount"),
    ]
    item_lines = ", ".join(line(n, *item) for n, item in enumerate(items, start=1))
    total = "amount + heat_amount + levies + vat"
    english = f"""concat_ws('\\n', concat('  Supplier ', l_suppkey, ' Energy GmbH '),
      concat('Customer: ', c_name), concat('Site: ', n_name), concat('Address: Street ', o_custkey, ', ', n_name),
      concat('Invoice number: ', doc_id), concat('Invoice date: ', date_format(o_orderdate, {iso})),
      concat('Billing period: ', date_format(first_day, {iso}), ' to ', date_format(last_day, {iso})),
      'Currency: USD', {item_lines},
      concat('Subtotal energy charges: ', format_number(amount + heat_amount, 2), ' EUR'),
      concat('Network & levies (approx.): ', format_number(levies, 2), ' EUR'),
      concat('VAT 19%: ', format_number(vat, 2), ' EUR'),
      concat('Total amount due: ', format_number({total}, 2), ' EUR'))"""
    german_text = f"""concat_ws('\\n', '', concat('Stadtwerk ', l_suppkey, ' AG'),
      concat('Kunde: ', c_name), concat('Standort: ', n_name), concat('Adresse: Street ', o_custkey, ', ', n_name),
      concat('Rechnungsnummer: ', doc_id), concat('Rechnungsdatum: ', date_format(o_orderdate, {german})),
      concat('Abrechnungszeitraum: ', date_format(first_day, {german}), ' – ', date_format(last_day, {german})),
      'Währung: CHF', {item_lines},
      concat('Zwischensumme: ', format_number(amount + heat_amount, 2), ' EUR'),
      concat('Netzentgelte & Umlagen: ', format_number(levies, 2), ' EUR'),
      concat('MwSt 19%: ', format_number(vat, 2), ' EUR'),
      concat('Gesamt: ', format_number({total}, 2), ' EUR'))"""
    head_english = "array('Line', 'Meter ID', 'Energy type', 'From', 'To', 'Consumption (kWh)', 'Unit price (EUR/kWh)', 'Amount (EUR)')"
    head_german = "array('Zeile', 'Zaehler-ID', 'Energieart', 'Von', 'Bis', 'Verbrauch (kWh)', 'Stueckpreis (EUR/kWh)', 'Betrag (EUR)')"

    def cells(n: int, meter: str, label: str, amount: str, price: str, amount_total: str) -> str:
        return (
            f"array('{n}', {meter}, {label}, date_format(first_day, {iso}), date_format(last_day, {iso}), "
            f"format_number({amount}, 0), '{price}', format_number({amount_total}, 2))"
        )

    rows = ", ".join(cells(n, *item) for n, item in enumerate(items, start=1))
    cell_table = (
        f"array(array(array('Note', c_name)), "
        f"array(CASE WHEN english THEN {head_english} ELSE {head_german} END, array('', ' ', null), {rows}))"
    )
    return invoice_facts(spark, sf_dir).select(
        F.concat("doc_id", F.lit(".pdf")).alias("filename"),
        F.expr("sha2(doc_id, 256)").alias("file_hash"),
        F.expr(f"CASE WHEN english THEN {english} ELSE {german_text} END").alias("text"),
        F.expr(f"CASE WHEN {tables} THEN {cell_table} END").alias("tables"),
    )


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a documents frame; none of them is an invoice."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.sha2("text", 256).alias("file_hash"),
        "text",
        F.lit(None).cast("array<array<array<string>>>").alias("tables"),
    )


# --- retrieval ----------------------------------------------------------------------------------

def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns as questions: ``query_id, question``."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question")
    )


def record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of the invoice records. Rows are dealt by their id before content and id are written out."""
    return staged(
        spark, sf_dir, "record-index",
        lambda: index_documents(_billed_orders(spark, sf_dir, lambda records: spread(records, F.sha2("filename", 256)))),
    )

"""Named queries over the driver's tables, one or more per operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark import functions as G
from ghgspark.constants import MAX_DOCUMENT_BYTES
from ghgspark.functions.embedding import hashed_terms
from ghgspark.operators import compare, context, enrich, index, invoices, nearest, profile, report
from ghgspark.operators.tabular import Export
from ghgspark.plans import adapters as A
from ghgspark.session import kept, scratch_path
from ghgspark.sources import listing as L
from ghgspark.sources import records as R
from ghgspark.sources.factors import default_factors, load_factors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _warnings_text(frame: DataFrame) -> DataFrame:
    return frame.withColumn("warnings", F.array_join("warnings", "; "))


# --- report ----------------------------------------------------------------------------

@query
def b3_totals(spark, sf):
    return _warnings_text(report.report(A.line_records(spark, sf))).drop("turnover_eur")


@query
def b3_by_site(spark, sf):
    return _warnings_text(report.report(A.line_records(spark, sf), by=["site"])).drop("turnover_eur")


@query
def b3_from_invoices(spark, sf):
    return _warnings_text(report.report(A.invoice_records(spark, sf), by=["site"], turnover=1_000_000.0))


@query
def b3_long(spark, sf):
    return report.named_values(report.report(A.line_records(spark, sf), by=["site"]), by=["site"])


@query
def b3_totals_by_type(spark, sf):
    return report.totals_by_type(A.line_records(spark, sf), by=["site"])


@query
def b3_unknown_types(spark, sf):
    return report.unknown_types(A.line_records(spark, sf), by=["site"])


@query
def b3_period_range(spark, sf):
    return report.period_range(A.line_records(spark, sf), by=["site"])


@query
def b3_span_warning(spark, sf):
    full = report.report(A.line_records(spark, sf), by=["site"])
    return full.select("site", F.explode("warnings").alias("warning")).where("warning like 'Data spans%'")


# --- enrichment ----------------------------------------------------------------------------

@query
def invoice_records(spark, sf):
    return A.invoice_records(spark, sf).drop("content").withColumn("emissions_tco2", F.round("emissions_tco2", 6))


@query
def invoice_records_per_line(spark, sf):
    totals = enrich.line_totals(
        A.billing_lines(spark, sf), "invoice_id", A.LINE_ORDER, default_factors(spark), per_line=True
    )
    return totals.withColumn("emissions_tco2", F.round("emissions_tco2", 6))


@query
def factor_usage(spark, sf):
    lines = enrich.with_factor(A.billing_lines(spark, sf), default_factors(spark))
    return lines.groupBy("energy_type", "emission_factor_value", "emission_factor_source").agg(
        F.count("*").alias("lines"), F.sum("consumption_kwh").alias("consumption_kwh")
    )


@query
def record_content(spark, sf):
    return A.invoice_records(spark, sf).select("filename", "content")


@query
def record_summary(spark, sf):
    return enrich.record_summary(A.invoice_records(spark, sf)).drop("emissions_tco2")


@query
def metadata_defaults(spark, sf):
    return A.invoice_records(spark, sf).select(F.col("pdf_hash").alias("id"), index.metadata().alias("m")).select(
        "id", *[(F.round(f"m.{n}", 6) if isinstance(d, float) else F.col(f"m.{n}")).alias(n)
                for n, d in index.METADATA_DEFAULTS.items()]
    )


@query
def record_union(spark, sf):
    exported = enrich.build_records(Export(A.export_lines(spark, sf)).documents(), default_factors(spark))
    both = enrich.union_records(A.invoice_records(spark, sf), exported)
    return both.groupBy("vendor_name", "energy_type").agg(
        F.count("*").alias("records"),
        F.round(F.sum(G.exact(F.col("consumption_kwh"))), 2).cast("double").alias("consumption_kwh"),
        F.round(F.sum(G.exact(F.col("emissions_tco2"))), 2).cast("double").alias("emissions_tco2"),
    )


@query
def run_counters(spark, sf):
    documents = A.invoice_documents(spark, sf).unionByName(A.plain_documents(spark, sf))
    parsed = invoices.parse_documents(documents)
    records = enrich.build_records(parsed, default_factors(spark))
    files = documents.select(F.lit("pdf").alias("kind")).unionByName(
        A.export_rows(spark, sf).select("file").distinct().select(F.lit("csv").alias("kind"))
    )
    return enrich.run_counters(files, records, enrich.parse_errors(parsed))


# --- scalar functions ---------------------------------------------------------------------------

@query
def energy_type_invoice(spark, sf):
    return A.billing_lines(spark, sf).groupBy("raw_label", "energy_type").agg(F.count("*").alias("lines"))


@query
def energy_type_sap(spark, sf):
    lines = A.table(spark, sf, "lineitem").join(
        A.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(F.concat(F.lit(" "), F.upper(F.expr(A.EXPORT_LABEL)), F.lit(" ")).alias("label"))
    return lines.withColumn("energy_type", G.export_energy_type(F.col("label"))).groupBy("label", "energy_type").agg(
        F.count("*").alias("lines")
    )


@query
def period_normalize(spark, sf):
    return A.table(spark, sf, "orders").select(
        "o_orderkey", G.normalize_period(F.expr(A.period_text("o_orderkey % 8"))).alias("period")
    )


@query
def period_rejects(spark, sf):
    text = F.concat(F.expr(A.period_text("o_orderkey % 8")), F.expr("if(o_orderkey % 5 = 0, 'x', '')"))
    return A.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 8).alias("shape"), G.normalize_period(text).alias("period")
    ).groupBy("shape").agg(F.count("*").alias("texts"), F.count_if(F.col("period").isNull()).alias("rejected"))


def _prices(spark, sf):
    return A.table(spark, sf, "lineitem").select("l_returnflag", F.format_number("l_extendedprice", 2).alias("text"))


def _price_sum(prices: DataFrame, value) -> DataFrame:
    return prices.groupBy("l_returnflag").agg(
        F.sum(value.cast("decimal(18,2)")).cast("double").alias("total"), F.count(value).alias("parsed")
    )


@query
def number_german(spark, sf):
    prices = _prices(spark, sf).withColumn("text", F.translate("text", ",.", ".,"))
    return _price_sum(prices, G.locale_number(F.col("text"), "german"))


@query
def number_english(spark, sf):
    return _price_sum(_prices(spark, sf), G.locale_number(F.col("text"), "english"))


@query
def clean_number(spark, sf):
    junk = F.when(F.col("l_returnflag") == "A", F.concat("text", F.lit(" EUR"))).otherwise(
        F.concat(F.lit("\t "), "text", F.lit(" "))
    )
    return _price_sum(_prices(spark, sf).withColumn("text", junk), G.clean_number(F.col("text")))


@query
def unit_convert(spark, sf):
    raw = F.expr("element_at(array('kwh', ' MWh', 'M3', 'Litre', 'm³', '', 'GJ '), l_linenumber % 7 + 1)")
    lines = A.table(spark, sf, "lineitem").select(G.unit_name(raw).alias("unit"), "l_quantity")
    return lines.groupBy("unit").agg(
        F.count("*").alias("lines"),
        F.sum(G.to_base_unit(F.col("l_quantity"), F.col("unit")).cast("decimal(18,4)")).cast("double").alias("amount"),
    )


@query
def umlaut_fold(spark, sf):
    folded = G.fold_umlauts(F.col("text"), accents=True)
    return A.table(spark, sf, "documents").select(
        "doc_id", F.char_length(folded).cast("bigint").alias("chars"), F.md5(folded).alias("digest")
    )


@query
def date_de_to_iso(spark, sf):
    german = F.date_format("o_orderdate", "dd.MM.yyyy")
    return A.table(spark, sf, "orders").select("o_orderkey", G.german_date_to_iso(german).alias("iso"))


@query
def first_line_vendor(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", G.first_line(F.col("text")).alias("vendor"))


@query
def fixed_decimals(spark, sf):
    value = F.col("l_quantity") * 0.00038 - 0.005
    return A.table(spark, sf, "lineitem").select(
        G.fixed_text(value, 4).alias("four"), G.fixed_text(value, 2, signed=True).alias("two"),
    ).groupBy("four", "two").agg(F.count("*").alias("lines"))


# --- exports --------------------------------------------------------------------------------------

@query
def encoding_profile(spark, sf):
    return profile.file_encoding(A.document_lines(spark, sf))


@query
def delimiter_profile(spark, sf):
    return Export(A.export_lines(spark, sf)).files.select("file", "encoding", "delimiter")


@query
def number_format_profile(spark, sf):
    return Export(A.export_lines(spark, sf)).files.select("file", "has_header", "number_format")


@query
def column_profile(spark, sf):
    files = Export(A.export_lines(spark, sf)).files
    return files.select("file", "min_cells", *[F.col(f"columns.{f}").alias(f"{f}_column") for f in profile.FIELDS])


@query
def sap_ingest(spark, sf):
    documents = Export(A.export_lines(spark, sf)).documents()
    item = F.col("line_items")[0]
    return documents.select(
        "invoice_number", F.col("site_address").alias("site"), F.col("billing_period_from").alias("period"),
        item["energy_type"].alias("energy_type"), F.round(item["consumption_kwh"], 4).alias("consumption_kwh"),
        item["consumption_unit"].alias("unit"), F.col("total_amount").alias("total_eur"), "currency",
        item["meter_id"].alias("meter_id"),
    )


@query
def sap_row_ids(spark, sf):
    return Export(A.export_lines(spark, sf)).documents().select("filename", "blob_name", "row_hash", "invoice_number")


@query
def sap_short_rows(spark, sf):
    return Export(A.export_lines(spark, sf)).skipped_rows()


@query
def sap_warnings(spark, sf):
    documents = Export(A.export_lines(spark, sf)).documents()
    found = documents.select("filename", F.explode_outer("warnings").alias("warning"))
    return found.where(F.col("warning").isNotNull()).groupBy("filename").agg(
        F.count("*").alias("warnings"), F.countDistinct("warning").alias("kinds")
    )


@query
def sap_raw_text(spark, sf):
    documents = Export(A.export_lines(spark, sf)).documents()
    return documents.select("blob_name", F.md5("raw_text").alias("raw_digest"))


@query
def sap_b3(spark, sf):
    records = enrich.build_records(Export(A.export_lines(spark, sf)).documents(), default_factors(spark))
    return _warnings_text(report.report(records, by=["site"])).drop("turnover_eur")


# --- invoices -----------------------------------------------------------------------------------------

@query
def invoice_headers(spark, sf):
    parsed = invoices.parse_documents(A.invoice_documents(spark, sf))
    return parsed.select(
        "invoice_number", "vendor_name", "customer_name", "site_address", "address", "invoice_date",
        "currency", "billing_period_from", "billing_period_to", "success",
    )


@query
def invoice_totals(spark, sf):
    parsed = invoices.parse_documents(A.invoice_documents(spark, sf))
    return parsed.select("invoice_number", "subtotal", "network_levies", "vat_amount", "total_amount")


@query
def invoice_rejects(spark, sf):
    everything = A.invoice_documents(spark, sf).unionByName(A.plain_documents(spark, sf))
    return enrich.parse_errors(invoices.parse_documents(everything)).drop("timestamp")


def _lines_of(spark, sf, tables: str) -> DataFrame:
    return invoices.invoice_lines(invoices.parse_documents(A.invoice_documents(spark, sf, tables))).drop("filename")


@query
def invoice_lines_text(spark, sf):
    return _lines_of(spark, sf, "false")


@query
def invoice_lines_table(spark, sf):
    return _lines_of(spark, sf, "true")


@query
def invoice_lines_fallback(spark, sf):
    parsed = invoices.parse_documents(A.invoice_documents(spark, sf))
    return parsed.select(
        F.explode_outer("warnings").alias("warning"), F.size("line_items").alias("n")
    ).where(F.col("warning").isNotNull()).groupBy("warning").agg(F.count("*").alias("documents"), F.sum("n").alias("items"))


@query
def invoice_document_records(spark, sf):
    parsed = invoices.parse_documents(A.invoice_documents(spark, sf))
    records = enrich.build_records(parsed, default_factors(spark))
    return records.select(
        "filename", "pdf_hash", "energy_type", "consumption_kwh", "consumption_unit", "total_eur", "currency",
        F.round("emissions_tco2", 6).alias("emissions_tco2"),
    )


# --- files and sinks -----------------------------------------------------------------------------------

@query
def admission(spark, sf):
    stored = A.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.expr("if(doc_id % 2 = 0, '.pdf', '.csv')")).alias("file"),
        F.expr("if(doc_id % 2 = 0, 'pdf', 'csv')").alias("kind"),
        (F.octet_length("text").cast("bigint") * 1000).alias("length"),
    )
    requested = stored.select("file").unionByName(
        A.table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("file"))
    )
    return L.admit(stored, requested, MAX_DOCUMENT_BYTES)


@query
def parse_accounting(spark, sf):
    """Files of documents (some missing, some without a byte, some without text) and of pages (all without text)."""
    documents, pages = A.table(spark, sf, "documents"), A.table(spark, sf, "pages")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    listed = documents.where("doc_id % 5 <> 0").select(
        name.alias("file"), F.lit("pdf").alias("kind"), F.expr("bigint(if(doc_id % 7 = 0, 0, octet_length(text)))").alias("length"),
    ).unionByName(pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("file"), F.lit("pdf").alias("kind"),
        F.octet_length("html").cast("bigint").alias("length")))
    told = documents.where("doc_id % 3 <> 0").select(
        name.alias("filename"), F.expr("if(doc_id % 4 = 0, ' \\n', text)").alias("text"))
    return L.account(listed, told)


@query
def records_copy(spark, sf):
    source, target = scratch_path(spark, "records"), scratch_path(spark, "copy")
    R.write_records_csv(A.invoice_records(spark, sf), source)
    R.copy_records(spark, source, target, "parquet")
    return spark.read.parquet(target).drop("pdf_hash", "vendor_name")


@query
def factor_file(spark, sf):
    """A factor file that brings a type of its own beside a built-in one."""
    path = scratch_path(spark, "factors")
    entries = ('{"electricity": {"value": 0.00038, "unit": "t/kWh", "source": "a", "year": 2024}, '
               '"heat": {"value": 0.00028, "unit": "t/kWh", "source": "b", "year": 2024, "energy_type": "Fernwaerme"}}')
    spark.range(1).select(F.lit(entries).alias("value")).coalesce(1).write.text(path)
    named = load_factors(spark, path).withColumn("energy_type", F.expr("if(name = 'electricity', 'electricity', energy_type)"))
    lines = enrich.with_factor(A.billing_lines(spark, sf), named)
    return lines.groupBy("energy_type", "emission_factor_value").agg(F.count("*").alias("lines"))


@query
def records_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "records")
    R.write_records_csv(A.invoice_records(spark, sf), path)
    return R.read_records_csv(spark, path).drop("pdf_hash", "vendor_name")


@query
def errors_csv(spark, sf):
    path = scratch_path(spark, "errors")
    R.write_errors_csv(enrich.parse_errors(invoices.parse_documents(A.plain_documents(spark, sf))), path)
    return spark.read.csv(path, header=True).select("filename", "error_type", "message")


# --- index and retrieval ---------------------------------------------------------------------------------

def _document_records(spark, sf, site: str) -> DataFrame:
    empty = {"consumption_kwh", "total_eur", "emissions_tco2"}
    given = {
        "pdf_hash": F.sha2("text", 256), "content": F.col("text"),
        "filename": F.format_string("doc-%010d", "doc_id"), "site": F.lit(site),
    }
    columns = [
        given.get(name, F.lit(None)).cast("double" if name in empty else "string").alias(name)
        for name in ("pdf_hash", "content", *index.METADATA_DEFAULTS)
    ]
    return A.table(spark, sf, "documents").join(
        A.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"
    ).select(*columns) if site else A.table(spark, sf, "documents").select(*columns)


def _upserted(spark, sf) -> index.RecordIndex:
    store = index.RecordIndex(spark, scratch_path(spark, "index"))
    store.upsert(index.index_documents(_document_records(spark, sf, "")))
    store.upsert(index.index_documents(_document_records(spark, sf, "relabelled")))
    return store


@query
def index_upsert(spark, sf):
    stored = _upserted(spark, sf).documents()
    return stored.select(
        "id", F.col("metadata.filename").alias("filename"), F.col("metadata.site").alias("site"),
        F.char_length("document").cast("bigint").alias("chars"),
    )


@query
def index_stream_replay(spark, sf):
    """Files of index rows streamed in two micro-batches, then the first one replayed: the replay writes nothing."""
    from ghgspark.streaming.records import index_rows_stream, upsert_batches

    folder, checkpoint = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-checkpoint")
    store = index.RecordIndex(spark, scratch_path(spark, "index"))
    first = index.index_documents(_document_records(spark, sf, ""))
    first.write.parquet(folder)
    source = spark.readStream.schema(first.schema).parquet(folder)
    index_rows_stream(source, store, checkpoint).awaitTermination()
    index.index_documents(_document_records(spark, sf, "relabelled")).write.mode("append").parquet(folder)
    index_rows_stream(source, store, checkpoint).awaitTermination()
    upsert_batches(store, checkpoint)(first, 0)
    return store.documents().select(
        "id", F.col("metadata.filename").alias("filename"), F.col("metadata.site").alias("site"),
        F.char_length("document").cast("bigint").alias("chars"),
    )


@query
def index_status(spark, sf):
    store = _upserted(spark, sf)
    return store.health()


@query
def index_reset(spark, sf):
    store = index.RecordIndex(spark, scratch_path(spark, "index"))
    given = store.upsert(index.index_documents(_document_records(spark, sf, "")))
    store.delete_all()
    return store.health().withColumn("given", F.lit(given).cast("bigint"))


@query
def index_reopen(spark, sf):
    path = scratch_path(spark, "index")
    index.RecordIndex(spark, path).upsert(index.index_documents(_document_records(spark, sf, "")))
    store = index.RecordIndex(spark, path)
    store.upsert(index.index_documents(_document_records(spark, sf, "")))
    store.compact()
    return store.documents().select("id", F.char_length("document").cast("bigint").alias("chars"))


@query
def embed_default(spark, sf):
    turns = hashed_terms(A.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")
    return turns.select("conv_id", "turn", F.posexplode_outer("embedding").alias("dimension", "weight")).where(
        "weight <> 0"
    ).withColumn("weight", F.round(F.col("weight").cast("double"), 5))


def _vectors(spark, sf, key: str, *more: str) -> DataFrame:
    return A.table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), "embedding", *more)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 4))


@query
def knn_topk(spark, sf):
    return _rounded(nearest.top_k(_vectors(spark, sf, "id"), _vectors(spark, sf, "query_id")))


@query
def knn_filtered(spark, sf):
    stored = _vectors(spark, sf, "id", "label")
    return _rounded(nearest.top_k(stored, _vectors(spark, sf, "query_id"), filters={"label": {"$eq": 3}}))


@query
def knn_cosine(spark, sf):
    return _rounded(nearest.top_k(_vectors(spark, sf, "id"), _vectors(spark, sf, "query_id"), k=3, metric="cosine"))


@query
def knn_with_bad_vectors(spark, sf):
    """Some vectors are null, some hold NaN, as questions and as stored rows: the others are found as before."""
    spoilt = F.expr("CASE vec_id % 10 WHEN 3 THEN transform(embedding, (x, i) -> if(i = 5, float('nan'), x)) "
                    "WHEN 7 THEN null ELSE embedding END")
    vectors = A.table(spark, sf, "embeddings").select("vec_id", spoilt.alias("embedding"))
    return _rounded(nearest.top_k(vectors.withColumnRenamed("vec_id", "id"), vectors.withColumnRenamed("vec_id", "query_id")))


@query
def knn_empty(spark, sf):
    hits = nearest.top_k(_vectors(spark, sf, "id", "label"), _vectors(spark, sf, "query_id"), filters={"label": -1})
    return hits.agg(F.count("*").alias("hits"))


def _asked(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, index and hits of all user turns over all invoice records."""
    questions = A.user_questions(spark, sf)
    stored = A.record_documents(spark, sf)
    vectors = kept(hashed_terms(A.spread(questions, "query_id"), "question"), "questions")
    hits = kept(nearest.top_k(stored, vectors), "hits")
    return questions, stored, nearest.with_documents(hits, stored)


@query
def record_hits(spark, sf):
    hits = _asked(spark, sf)[2]
    return hits.select("query_id", "rank", F.col("metadata.filename").alias("filename"),
                       F.round("distance", 4).alias("distance"))


@query
def context_blocks(spark, sf):
    return context.context_blocks(_asked(spark, sf)[2])


@query
def prompts(spark, sf):
    questions, _, hits = _asked(spark, sf)
    return context.prompts(questions, hits, "Answer from the context only.").select("query_id", "user")


@query
def sources(spark, sf):
    return context.sources(_asked(spark, sf)[2]).withColumn("distance", F.round("distance", 4))


@query
def sources_distinct(spark, sf):
    return context.distinct_sources(_asked(spark, sf)[2])


@query
def ask_status(spark, sf):
    questions = A.user_questions(spark, sf)
    stored = A.record_documents(spark, sf)
    hits = nearest.top_k(stored, hashed_terms(questions, "question"), filters={"energy_type": "diesel"})
    return context.statuses(questions, hits, stored)


# --- comparison ----------------------------------------------------------------------------------------------

@query
def compare_first_last(spark, sf):
    records = A.invoice_records(spark, sf)
    found = compare.first_last(records, by=["site"], order=["invoice_number"])
    return found.select(
        *[c for c in found.columns if c not in ("first_value", "last_value", "difference", "percent")],
        *[F.round(c, 4).alias(c) for c in ("first_value", "last_value", "difference", "percent")],
    )


@query
def compare_hits(spark, sf):
    found = compare.first_last(_asked(spark, sf)[2], by=["query_id"])
    return found.select("query_id", "energy_type", "invoices", "first_period", "last_period", "metric",
                        F.round("difference", 4).alias("difference"), F.round("percent", 4).alias("percent"))


@query
def compare_series(spark, sf):
    found = compare.series(_asked(spark, sf)[2])
    return found.select(
        "query_id", "energy_type", "invoices", F.array_join("periods", ",").alias("periods"),
        F.array_join(F.transform("consumption_kwh_series", lambda v: v.cast("bigint").cast("string")), ",").alias("consumption"),
    )


@query
def compare_text(spark, sf):
    return compare.analytics_text(_asked(spark, sf)[2])

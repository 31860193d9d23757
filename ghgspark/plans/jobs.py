"""The three entry points as Spark jobs: parse, ask, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.constants import DEFAULT_TOP_K
from ghgspark.functions.embedding import hashed_terms
from ghgspark.operators import context, enrich, index, invoices, nearest, report
from ghgspark.operators.tabular import Export
from ghgspark.session import scratch_path
from ghgspark.sources import lines as line_source
from ghgspark.sources import listing, records
from ghgspark.sources.factors import default_factors


def _stored(frame: DataFrame, label: str) -> DataFrame:
    """Evaluated once, into the shared scratch folder; survives lost executors."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@dataclass
class ParseResult:
    counters: DataFrame
    records: DataFrame
    errors: DataFrame
    records_path: str | None
    errors_path: str | None


def parse(
    spark: SparkSession,
    folder: str,
    output: str,
    documents: DataFrame | None = None,
    factors: DataFrame | None = None,
    store: index.RecordIndex | None = None,
    max_bytes: int | None = None,
) -> ParseResult:
    """Parse a folder's exports and, if given, its documents' extracted text and tables.

    Everything is parsed before anything is written; then come the record CSV, the index and
    the error CSV. ``documents`` has ``filename, file_hash, text[, tables]``. Every document file and every
    row of ``documents`` ends as a record or as an error row: also files that are missing, empty, too large for
    ``max_bytes``, or without text.
    """
    factors = default_factors(spark) if factors is None else factors
    found_files = listing.list_inputs(spark, folder)
    files = _stored(listing.admit(found_files, max_bytes=max_bytes) if documents is None
                    else listing.account(found_files, documents, max_bytes), "files")
    parts, failures = [], [
        enrich.error_rows(
            files.where(F.col("error").isNotNull()).select(F.col("file").alias("filename"), F.col("error").alias("message")),
            "parse_error",
        )
    ]
    export, skipped = None, None
    if not files.where((F.col("kind") == "csv") & F.col("admitted")).isEmpty():
        export = Export(line_source.read_lines(spark, folder))
        skipped = export.skipped_rows()
        parts.append(enrich.build_records(export.documents(), factors))
        failures.append(enrich.error_rows(export.file_errors(), "csv_parse_error"))
    if documents is not None:
        admitted = files.where(F.col("admitted")).select(F.col("file").alias("filename"))
        parsed = invoices.parse_documents(documents.join(admitted, "filename", "left_semi"))
        parts.append(enrich.build_records(parsed, factors))
        failures.append(enrich.parse_errors(parsed))
    found = enrich.union_records(*parts) if parts else spark.createDataFrame(
        [], ", ".join(f"{name} {kind}" for name, kind in enrich.RECORD_COLUMNS.items())
    )
    found, errors = _stored(found, "records"), _stored(enrich.union_records(*failures), "errors")
    skipped = _stored(skipped, "skipped") if skipped is not None else spark.createDataFrame([], "file string, skipped_rows long")
    if export is not None:
        export.release()
    records_path, errors_path = f"{output}/invoices", f"{output}/errors"
    wrote = records.write_records_csv(found, records_path)
    if wrote and store is not None:
        store.upsert(index.index_documents(found))
    failed = records.write_errors_csv(errors, errors_path)
    return ParseResult(
        enrich.run_counters(files, found, errors, skipped), found, errors,
        records_path if wrote else None, errors_path if failed else None,
    )


@dataclass
class Answers:
    statuses: DataFrame
    prompts: DataFrame
    sources: DataFrame


def ask(
    questions: DataFrame, stored: DataFrame, system: str, k: int = DEFAULT_TOP_K, embed=hashed_terms, filters=None
) -> Answers:
    """Retrieval for a table of questions (``query_id, question``): state, prompt and sources each.

    ``system`` is the caller's instruction in every prompt. Question vectors and hits are computed once.
    """
    vectors = _stored(embed(questions, "question", "embedding"), "questions")
    hits = _stored(nearest.with_documents(nearest.top_k(stored, vectors, k, filters), stored), "hits")
    return Answers(
        context.statuses(questions, hits, stored), context.prompts(questions, hits, system), context.sources(hits)
    )


def export_report(spark: SparkSession, records_csv: str, turnover: float | None = None, by: tuple[str, ...] = ()):
    """Report and its named values from a record CSV (whose numbers have four decimals)."""
    found = report.report(records.read_records_csv(spark, records_csv), by, turnover)
    return found, report.named_values(found, by)


__all__ = ["Answers", "ParseResult", "ask", "export_report", "parse"]

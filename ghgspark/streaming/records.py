"""Streams of parsed documents into the record index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ghgspark.operators.enrich import build_records
from ghgspark.operators.index import RecordIndex, index_documents
from ghgspark.operators.invoices import parse_documents


def index_stream(documents: DataFrame, factors: DataFrame, store: RecordIndex, checkpoint: str) -> StreamingQuery:
    """Parse, enrich and index a stream of documents (``filename, file_hash, text[, tables]``).

    Each micro-batch is upserted by id under the commit key (checkpoint, batch id), so a batch replayed after a
    failure is skipped and leaves the index as it was.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        store.upsert(index_documents(build_records(parse_documents(batch), factors)), commit=f"{checkpoint}#{batch_id}")

    return (
        documents.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_batches(store: RecordIndex, checkpoint: str):
    """The foreachBatch body that upserts a stream of index rows under (checkpoint, batch id) commit keys."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch.select("id", "document", "embedding", "metadata"), commit=f"{checkpoint}#{batch_id}")

    return upsert


def index_rows_stream(rows: DataFrame, store: RecordIndex, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of index rows (``id, document, embedding, metadata``); replayed micro-batches are skipped."""
    return (
        rows.writeStream.foreachBatch(upsert_batches(store, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

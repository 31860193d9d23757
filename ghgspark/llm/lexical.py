"""Ranked lexical search with hashed max-sketches over blocks of documents.

Every (document, term) posting carries an integer impact, the term's weight times its saturated frequency. Documents
are dealt into blocks; a block's sketch holds, per hashed slot, the largest impact of any term of that slot in any of
its documents. Summing the sketch at a query's slots bounds every document score of the block from above (collisions
only raise it). Blocks are rescored exactly in descending order of their bound, a few more per round, until no
remaining block's bound reaches the query's current 10th score.

Counting, weights, sketches and bounds are built-in functions on Spark; the exact rescoring of a round is a scan of
the candidate blocks' postings in which each task scores whole documents. The driver keeps two corpus counts and a loop over rounds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import staged

# Fixed values of the scoring contract: term characters, weights and length normalisation.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct item terms up to which they are sent to every task; beyond, joins shuffle.
BROADCAST_TERMS = 1_000_000
COUNTED_TYPES = "_row long, doc_id long, _n long, term string, tf long"
COUNTED = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("_n", pa.int64()), ("term", pa.string()),
                     ("tf", pa.int64())])
SCORED_TYPES = "item_id long, _null boolean, _row long, doc_id long, score long"
SCORED = pa.schema([("item_id", pa.int64()), ("_null", pa.bool_()), ("_row", pa.int64()), ("doc_id", pa.int64()),
                    ("score", pa.int64())])


def terms(text: str) -> F.Column:
    """Maximal runs of term characters of a text with only A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def count_terms(vocabulary: frozenset | None):
    """A task body: per document one row carrying n (term null), then (term, tf) of its terms in ``vocabulary`` (all
    terms if None). Documents without terms give no rows; rows keep the scan order, a document's rows consecutive."""
    lower = str.maketrans(UPPER, LOWER)
    find = re.compile(TERM).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            out_row, out_id, out_n, out_term, out_tf = [], [], [], [], []
            for row, doc_id, text in zip(rows, ids, texts):
                found = find(text.translate(lower)) if text else []
                if not found:
                    continue
                n = len(found)
                out_row.append(row), out_id.append(doc_id), out_n.append(n), out_term.append(None), out_tf.append(0)
                for term, tf in Counter(found).items():
                    if vocabulary is None or term in vocabulary:
                        out_row.append(row), out_id.append(doc_id), out_n.append(n), out_term.append(term)
                        out_tf.append(tf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_row, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_n, pa.int64()),
                 pa.array(out_term, pa.string()), pa.array(out_tf, pa.int64())], schema=COUNTED)
    return run


def index(documents: DataFrame, vocabulary: DataFrame, docs_per_block: int = 256) -> tuple[DataFrame, int, int]:
    """Postings of the vocabulary's terms (block, _row, doc_id, term, g), with the corpus counts N and L.

    Every row of ``documents`` is a document of its own (repeated rows too); rows with a null doc_id count in N, L and
    df like any other but are never returned. g is (10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L.

    Each scan task counts the terms of its documents (no shuffle) and keeps one row per document for N and L plus the
    vocabulary's terms; the vocabulary goes to every task while it has at most ``BROADCAST_TERMS`` terms, beyond that
    all postings are kept (the later joins with the items' terms pick theirs). A document's postings stay
    consecutive. A block is ``docs_per_block`` (rounded up to a power of two) consecutive rows of one scan task.
    """
    shift = max(0, (docs_per_block - 1).bit_length())
    small = vocabulary.count() <= BROADCAST_TERMS
    words = frozenset(r["term"] for r in vocabulary.collect()) if small else None
    counted = documents.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"),
                               F.col("text").cast("string")).mapInArrow(count_terms(words), COUNTED_TYPES)
    kept = staged(counted, "lexical-postings")
    totals = kept.where("term is null").agg(F.count("*").alias("N"), F.sum("_n").alias("L")).first()
    n_docs, n_terms = int(totals["N"]), int(totals["L"] or 0)
    postings = kept.where("term is not null").selectExpr(
        f"shiftright(_row, {shift}) as block", "_row", "doc_id", "term",
        f"div(1000000000 * tf, 1000 * tf + 8 * (10 + div(90 * _n * {max(1, n_docs)}, {max(1, n_terms)}))) as g")
    return postings, n_docs, n_terms


def rescore(least: dict, wanted: pd.DataFrame):
    """A task body: exact scores of the candidate blocks' documents for their items.

    A document's postings are consecutive, so every document but the task's first and last is complete here and is
    kept only if its score reaches its item's k-th score so far (``least``); the two at the edges go on as partial sums.
    ``wanted`` holds (block, term, item_id, _null, w) of the round's candidate blocks and their items' terms.
    """
    def scores(frame: pd.DataFrame, edge: bool) -> pd.DataFrame:
        frame = frame[frame.doc_id.notna()]
        met = frame.merge(wanted, on=["block", "term"])
        met = met.assign(score=met.w * met.g).groupby(["item_id", "_null", "_row", "doc_id"], as_index=False)["score"].sum()
        if not edge:
            floor = [least.get((i, n), 1) for i, n in zip(met.item_id, met._null)]
            met = met[met.score >= np.maximum(floor, 1)]
        return met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, first = None, None
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
            if frame.empty:
                continue
            if first is None:
                first = frame._row.iloc[0]
            last = frame._row.to_numpy() == frame._row.iloc[-1]
            carry, body = frame[last], frame[~last]
            edge = body._row.to_numpy() == first
            for part, is_edge in ((body[~edge], False), (body[edge], True)):
                out = scores(part, is_edge)
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, schema=SCORED, preserve_index=False)
        if carry is not None and len(carry):
            out = scores(carry, True)
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=SCORED, preserve_index=False)
    return run


def search(documents: DataFrame, items: DataFrame, k: int = 10, docs_per_block: int = 256, slots: int = 8192,
           first_round: int = 4, most_candidates: int = 1 << 20) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    A score sums w * g over the item's distinct terms, w = floor(1000 ln((2N + 2) / (2 df + 1))). Equal scores go by
    ascending doc_id; ranks are unique. Rows of one item_id are one item (their terms together); a null item_id is an
    item of its own. Items without terms, an empty table or documents without terms give no rows. Extra columns of
    either table are ignored.

    The sketch holds the coordinates that the batch of items reads: per block and hashed slot the largest impact of
    the items' terms. Round r rescoring takes each unfinished item's next ``first_round * 4^r`` blocks by bound; an
    item is finished when no block left has a bound at or above its k-th score (1 while it has fewer than k), so the
    result is exact. A round's (item, block) pairs go to every task, at most ``most_candidates`` at once.
    """
    spark = documents.sparkSession
    keys = ["item_id", "_null"]
    # Items are keyed by (item_id, _null) with a null id as 0 and _null set, so that every join matches it.
    item_terms = staged(
        items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item_id"),
                     F.col("item_id").isNull().alias("_null"), F.explode(terms("text")).alias("term")).distinct(),
        "lexical-items")
    postings, n_docs, _ = index(documents, item_terms.select("term").distinct(), docs_per_block)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_docs:
        return empty
    weights = postings.groupBy("term").count().selectExpr(
        "term", f"cast(floor(1000 * ln((2D * {n_docs} + 2) / (2D * count + 1))) as long) as w")
    asked = staged(item_terms.join(weights, "term").withColumn(
        "slot", F.expr(f"cast(pmod(xxhash64(term), {slots}) as int)")), "lexical-asked")
    term_weights = asked.select("term", "w", "slot").distinct()
    sketch = (
        postings.join(F.broadcast(term_weights) if term_weights.count() <= BROADCAST_TERMS else term_weights, "term")
        .groupBy("block", "slot").agg(F.max(F.col("w") * F.col("g")).alias("most"))
    )
    bounds = staged(
        asked.join(sketch, "slot").groupBy(*keys, "block").agg(F.sum("most").alias("bound")).where("bound > 0"),
        "lexical-bounds")
    n_items = asked.select(*keys).distinct().count()
    asked_local = asked.select(*keys, "term", "w").toPandas()
    best = spark.createDataFrame([], "item_id long, _null boolean, rank int, doc_id long, score long")
    done = spark.createDataFrame([], "item_id long, _null boolean, block long")
    take, rounds = first_round, 0
    while True:
        take = max(1, min(take, most_candidates // max(1, n_items)))
        least_rows = best.where(f"rank = {k}").select(*keys, F.col("score").alias("least"))
        left = (
            bounds.join(done, [*keys, "block"], "left_anti")
            .join(least_rows, keys, "left")
            .where("bound >= coalesce(least, 1)")
            .withColumn("order", F.expr("row_number() over (partition by item_id, _null order by bound desc, block)"))
            .where(f"order <= {take}").select(*keys, "block")
        )
        left = staged(left, f"lexical-round{rounds}")
        chosen = left.count()
        if not chosen:
            break
        least = {(r["item_id"], r["_null"]): r["least"] for r in least_rows.collect()}
        found = []
        for part in range(-(-chosen // most_candidates)):
            piece = left.where(f"pmod(xxhash64(item_id, _null, block), {-(-chosen // most_candidates)}) = {part}")
            wanted = piece.toPandas().merge(asked_local, on=keys)
            # Only the candidate blocks' postings reach Python; whole blocks stay in scan order.
            blocks = F.broadcast(spark.createDataFrame(wanted[["block"]].drop_duplicates(), "block long"))
            found.append(postings.join(blocks, "block", "left_semi").mapInArrow(rescore(least, wanted), SCORED_TYPES))
        scored = found[0]
        for other in found[1:]:
            scored = scored.unionByName(other)
        scored = scored.groupBy(*keys, "_row", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
        best = staged(
            best.select(*keys, "doc_id", "score").unionByName(scored.select(*keys, "doc_id", "score"))
            .withColumn("rank", F.expr(
                "cast(row_number() over (partition by item_id, _null order by score desc, doc_id) as int)"))
            .where(f"rank <= {k}").select(*keys, "rank", "doc_id", "score"),
            f"lexical-best{rounds}")
        done = staged(done.unionByName(left), f"lexical-done{rounds}")
        take, rounds = min(take * 4, 1 << 30), rounds + 1
    return best.select(F.when(~F.col("_null"), F.col("item_id")).alias("item_id"), "rank", "doc_id", "score")

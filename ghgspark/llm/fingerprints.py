"""I-Match fingerprints by built-in functions.

Terms inside a band of inverse document frequency form the lexicon. A document's distinct lexicon terms are sorted, and
the terms of each of several randomised subsets of the lexicon are hashed together. Subsets of several densities serve
short and long documents; two documents are as alike as the share of their subset hashes that agree.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ghgspark.llm.common import buckets_for, staged

#: Terms are told apart by their slot; counts are exact per slot. Frequent slots are at most a document's mean number of
#: terms over the band's lower share, whatever the corpus, so chance meetings of terms in a slot stay as rare.
SLOTS = 1 << 22
#: Shares of documents between which a term counts: idf from ln(1 / 0.1) to ln(1 / 0.001).
BAND = (0.001, 0.1)
#: Subsets per density; a term is in one subset of the first density, and in every 4th, 16th, 64th of the next.
SUBSETS = 16
DENSITIES = (1, 4, 16, 64)


def slots(text: str) -> str:
    """Distinct slots of the lower-cased runs of letters and digits; slot 0 stands for the empty run."""
    word = r"'[^\\p{L}\\p{N}]+'"
    return (f"array_distinct(transform(split(lower({text}), {word}), "
            f"w -> if(w = '', 0, cast(pmod(xxhash64(w), {SLOTS - 1}) as int) + 1)))")


def lexicon(documents: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row with ``bits``: SLOTS bits in longs, set for slots within the band. Document frequencies cover all rows."""
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    total = documents.count()
    counts = texts.select(F.explode(F.expr(slots("text"))).alias("slot")).groupBy("slot").count()
    inside = counts.where(f"slot > 0 and count >= {band[0] * total} and count <= {max(1.0, band[1] * total)}")
    words = inside.groupBy(F.expr("cast(shiftright(slot, 6) as int)").alias("i")).agg(
        F.expr("bit_or(shiftleft(1L, slot & 63))").alias("bits"))
    every = documents.sparkSession.range(SLOTS // 64).select(F.col("id").cast("int").alias("i"))
    # One row per 64 slots: 65,536 in all, at any size of the corpus.
    return every.join(words, "i", "left").select("i", F.coalesce("bits", F.lit(0)).alias("bits")).agg(
        F.expr("transform(array_sort(collect_list(struct(i, bits))), x -> x.bits)").alias("bits"))


def terms(text: str, bits: str) -> str:
    """Sorted distinct lexicon terms of a text."""
    return (f"array_sort(filter({slots(text)}, "
            f"s -> (shiftright(element_at({bits}, shiftright(s, 6) + 1), s & 63) & 1L) = 1L))")


#: The hash of no terms at all, cut to 16 bits: a subset without terms.
EMPTY = 42


def codes(found: str) -> str:
    """A 16-bit hash of the terms in every subset. ``found`` is sorted, so equal sets hash equally."""
    parts = []
    for density, every in enumerate(DENSITIES):
        place = f"pmod(xxhash64(s, {1000 + density}), {SUBSETS * every})"
        members = f"transform(filter(f, s -> {place} < {SUBSETS}), s -> shiftleft(bigint(s), 4) + {place})"
        parts.append(
            f"flatten(transform(array({members}), t -> transform(sequence(0, {SUBSETS - 1}), "
            f"i -> int(xxhash64(filter(t, s -> (s & 15) = i)) & 65535))))")
    # The array of one element names a value, so that it is computed once.
    return f"flatten(transform(array({found}), f -> concat({', '.join(parts)})))"


def likeness(left: str, right: str) -> str:
    """Share of agreeing subsets among those that either side has terms of: in the sparsest density with four of them,
    else over all densities; 0 without any."""
    def counted(start: int, n: int) -> tuple[str, str]:
        both = f"slice({left}, {start}, {n}), slice({right}, {start}, {n})"
        used = f"size(filter(zip_with({both}, (x, y) -> x <> {EMPTY} or y <> {EMPTY}), b -> b))"
        same = f"size(filter(zip_with({both}, (x, y) -> x = y and x <> {EMPTY}), b -> b))"
        return used, same

    cases = ""
    for density in reversed(range(len(DENSITIES))):
        used, same = counted(1 + density * SUBSETS, SUBSETS)
        cases += f"when {used} >= 4 then {same} / {used} "
    used, same = counted(1, SUBSETS * len(DENSITIES))
    return f"double(case {cases} when {used} > 0 then {same} / {used} else 0 end)"


def fingerprint(codes_: str, text: str) -> str:
    """Text form: the subsets' hashes, or the text's own hash if no lexicon term occurs."""
    return (f"if(forall({codes_}, c -> c = {EMPTY}), concat('text:', hex(xxhash64({text}))), "
            f"array_join(transform({codes_}, c -> lpad(hex(c), 4, '0')), ''))")


def fingerprints(documents: DataFrame, bits: DataFrame) -> DataFrame:
    """The documents with ``codes`` and ``fingerprint`` of the whole text (null: empty) over a lexicon."""
    view = f"lexicon_{uuid.uuid4().hex}"
    bits.createOrReplaceTempView(view)
    coded = documents.withColumn("_bits", F.expr(f"(select bits from {view})")).withColumn(
        "codes", F.expr(codes(terms("coalesce(text, '')", "_bits")))).drop("_bits")
    return coded.withColumn("fingerprint", F.expr(fingerprint("codes", "coalesce(text, '')")))


def with_next(frame: DataFrame, values: list[str], rows_per_bucket: int = 2048, most_buckets: int = 8192) -> DataFrame:
    """Add ``_next``: a struct of ``values`` of the row with the next larger doc_id; after the last row comes the first.

    Rows are dealt to ranges of doc_id with about equal counts; the first rows of a range also go, as copies, to the
    range before, so that one shuffle brings every row and its successor together. Null ids come first; rows with one id
    follow each other by the order of ``values``.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = frame.select(key.alias("id"))
    total = ids.count()
    buckets = min(most_buckets, buckets_for(total, rows_per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(ids.select(F.percentile_approx("id", shares, 20 * buckets)).first()[0] or [])) if shares else []
    steps = len(bounds).bit_length()
    padded = F.lit(np.array([*bounds, *[(1 << 63) - 1] * ((1 << steps) - len(bounds))], np.int64))
    halves = F.lit(np.array([1 << k for k in reversed(range(steps))], np.int32)) if steps else F.array().cast("array<int>")

    def bucket(value):
        """How many bounds are at most the value, by binary search."""
        return F.aggregate(halves, F.lit(0), lambda low, half: F.when(
            F.element_at(padded, low + half) <= value, low + half).otherwise(low))

    firsts = dict(ids.groupBy(bucket(F.col("id")).alias("bucket")).agg(F.min("id")).collect())
    used = sorted(firsts)
    first = np.full((1 << steps) + 1, (1 << 63) - 1, np.int64)
    before, wraps = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
    for i, b in enumerate(used):
        first[b], before[b], wraps[b] = firsts[b], used[i - 1], int(i == 0)
    at = F.col("_bucket") + 1
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("wrap"), F.lit(False).alias("copy"))
    copy = F.struct(F.element_at(F.lit(before), at).alias("bucket"), F.element_at(F.lit(wraps), at).alias("wrap"),
                    F.lit(True).alias("copy"))
    rows = frame.withColumn("_id", key).withColumn("_bucket", bucket(F.col("_id"))).withColumn(
        "_to", F.explode(F.when(F.col("_id") == F.element_at(F.lit(first), at), F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("_to.bucket").orderBy("_to.wrap", "_id", "_to.copy", *values)
    return rows.withColumn("_next", F.lead(F.struct(*values)).over(order)).where("not _to.copy").drop("_id", "_bucket", "_to")


def edited_fingerprints(documents: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document's text. A
    null text is empty. Equal texts have equal fingerprints. An empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = staged(lexicon(texts, band), "lexicon")
    coded = with_next(fingerprints(texts, bits), ["text", "codes", "fingerprint"])
    edited = coded.withColumn("n_chars", F.length("text").cast("long")).withColumn("_edited", F.expr(
        "concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(_next.text, 1, int(n_chars div 2)))"))
    again = fingerprints(
        edited.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), F.col("codes").alias("_codes"),
                      F.col("fingerprint").alias("_fingerprint"), "_next.codes", "_next.fingerprint",
                      F.col("_edited").alias("text")).withColumnsRenamed({"codes": "_next_codes", "fingerprint": "_next_print"}),
        bits)
    return again.select(
        "doc_id", "n_chars", "edited_sha256", F.col("_fingerprint").alias("fingerprint"),
        F.col("fingerprint").alias("edited_fingerprint"),
        F.expr(f"if(_fingerprint = fingerprint, 1D, {likeness('_codes', 'codes')})").alias("near_edited"),
        F.expr(f"if(_fingerprint = _next_print, 1D, {likeness('_codes', '_next_codes')})").alias("near_next"))

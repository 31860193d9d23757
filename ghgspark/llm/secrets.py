"""Secret scans by built-in functions: three base patterns, and two character Markov models for other random strings.

One model is trained on the values behind base hits (random strings), the other on other words of the same texts
(ordinary identifiers). A candidate is reported if the mean log-likelihood ratio of its character pairs is high enough.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Quick tests that every text with a hit passes.
HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA[A-Z0-9]",
    "hex": HEX,
    "markov": r"[A-Za-z0-9+/_=-]{16}",
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_DOCUMENTS = 20_000
SPAN = "array<struct<start:int,kind:int,end:int>>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits(text: str, kind: str, pattern: str, keep: str) -> Column:
    """Spans (start, kind, end) of the pattern's matches in code points, from left to right without overlap.

    The pieces between the matches and the matches alternate, so their lengths give the places. ``keep`` is a condition
    on a match ``h``.
    """
    number = KINDS.index(kind)
    found = f"regexp_extract_all({text}, {quoted(pattern)}, 0)"
    gaps = f"split({text}, {quoted(pattern)}, -1)"
    walk = f"""
        aggregate(zip_with(slice({gaps}, 1, size({found})), {found}, (g, h) -> struct(g as g, h as h)),
            struct(0 as at, cast(array() as {SPAN}) as spans),
            (acc, x) -> struct(
                acc.at + length(x.g) + length(x.h) as at,
                concat(acc.spans, if({keep.format(h='x.h')},
                    array(struct(acc.at + length(x.g) as start, {number} as kind, acc.at + length(x.g) + length(x.h) as end)),
                    cast(array() as {SPAN}))) as spans),
            acc -> acc.spans)"""
    return F.expr(f"if({text} rlike {quoted(HINTS[kind])}, {walk}, cast(array() as {SPAN}))")


def base_spans(frame: DataFrame, text: str = "_text") -> DataFrame:
    """Add _assign, _access, _hex: the base kinds' spans."""
    return frame.select(
        "*",
        hits(text, "assign", ASSIGN, f"length(regexp_extract({{h}}, {quoted('^' + ASSIGN + '$')}, 1)) >= 6").alias("_assign"),
        hits(text, "access", ACCESS, "length({h}) >= 20").alias("_access"),
        hits(text, "hex", HEX, "true").alias("_hex"),
    )


def train_ratios(documents: DataFrame, bound: int = SAMPLE_DOCUMENTS, smoothing: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of every character following another, by position in ALPHABET.

    Labelled samples come from about ``bound`` documents, chosen by the hash of doc_id and text: values behind base hits
    are random strings (and so are their capitals), other words of 6 or more characters are ordinary, but for those that
    could be random strings themselves. Only counts of character pairs (at most
    2 * 67 * 67) reach the driver.
    """
    total = documents.count()
    share = max(1, math.ceil(total / bound))
    sample = base_spans(
        documents.select(F.coalesce("text", F.lit("")).alias("_text"), F.xxhash64("doc_id", "text").alias("_hash"))
        .where(F.pmod("_hash", F.lit(share)) == 0)
    )
    random = F.expr("""flatten(transform(concat(_assign, _access, _hex), s ->
        regexp_extract_all(substring(_text, s.start + 1, s.end - s.start), '[A-Za-z0-9+/_=-]{16,}', 0)))""")
    words = F.expr("""filter(array_distinct(regexp_extract_all(_text, '[A-Za-z0-9+/_=-]{6,}', 0)),
        w -> length(w) < 16 or not (w rlike '[0-9]' and w rlike '[A-Za-z]'))""")
    labelled = sample.select(random.alias("random"), words.alias("words")).select(
        F.expr("concat(transform(array_distinct(concat(random, transform(random, w -> upper(w)))),"
               " w -> struct(1 as label, w as word)),"
               " transform(array_except(words, random), w -> struct(0 as label, w as word)))").alias("all"))
    pairs = (
        labelled.select(F.explode("all").alias("x"))
        .groupBy("x.label", "x.word").count()
        .select("label", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair"))
        .groupBy("label", "pair").count()
    )
    counts = np.full((2, len(ALPHABET), len(ALPHABET)), smoothing)
    for row in pairs.collect():
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b >= 0:
            counts[row["label"], a, b] += row["count"]
    chance = counts / counts.sum(axis=2, keepdims=True)
    return np.log(chance[1]) - np.log(chance[0])


def find_spans(documents: DataFrame, ratios: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """The documents with _assign, _access, _hex and _markov spans (code points, end exclusive) of their whole text
    ``_text`` (null: empty). A _markov span is a run of 16 or more characters of ALPHABET with a letter and a digit,
    apart from all base spans, whose mean ratio exceeds ``threshold``."""
    frame = base_spans(documents.withColumn("_text", F.coalesce("text", F.lit(""))))
    n = len(ALPHABET)
    table = F.lit(ratios.reshape(-1).astype(np.float64)).alias("_ratios")
    code = "(locate(substring(_word, {i}, 1), '" + ALPHABET + "') - 1)"

    def ratio(word: str) -> str:
        first, second = (code.format(i=i).replace("_word", word) for i in ("i", "i + 1"))
        return (f"aggregate(sequence(1, length({word}) - 1), 0D, (acc, i) -> acc + "
                f"element_at(_ratios, {first} * {n} + {second} + 1)) / (length({word}) - 1)")

    candidates = hits("_text", "markov", CANDIDATE, "{h} rlike '[0-9]' and {h} rlike '[A-Za-z]'")
    frame = frame.select("*", candidates.alias("_candidates"), table)
    apart = """filter(_candidates, c -> not exists(concat(_assign, _access, _hex),
        b -> b.start < c.end and c.start < b.end))"""
    return frame.select("*", F.expr(f"""if(size(_candidates) = 0, _candidates,
        filter({apart}, c -> {ratio('substring(_text, c.start + 1, c.end - c.start)')} > {threshold}))""").alias("_markov")
    ).drop("_ratios", "_candidates")


def listed(spans: str) -> str:
    names = "array('assign', 'access', 'hex', 'markov')"
    return (f"array_join(transform(array_sort({spans}), s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)),"
            " ',')")


def scan_secrets(documents: DataFrame, ratios: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. Each row stands alone: repeated rows repeat, an empty
    table gives none; null ids stay null."""
    ratios = train_ratios(documents) if ratios is None else ratios
    return find_spans(documents.select("doc_id", "text"), ratios).selectExpr(
        "doc_id", "cast(size(_assign) as long) as n_assign", "cast(size(_access) as long) as n_access",
        "cast(size(_hex) as long) as n_hex", f"sha2({listed('concat(_assign, _access, _hex)')}, 256) as base_sha256",
        f"{listed('concat(_assign, _access, _hex, _markov)')} as spans")


def redact(documents: DataFrame, ratios: np.ndarray | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span's characters replaced by ``mask`` (touching spans by one), and n_chars to match.

    Texts without a span, null ones too, stay as they are. Further columns pass through.
    """
    ratios = train_ratios(documents) if ratios is None else ratios
    whole = documents.select(F.struct("*").alias("_row"), "text")  # further columns cannot clash with the spans'
    found = find_spans(whole, ratios).withColumn("_spans", F.expr("array_sort(concat(_assign, _access, _hex, _markov))"))
    cleaned = f"""aggregate(_spans, struct(0 as at, array('') as parts),
        (acc, s) -> struct(greatest(acc.at, s.end) as at,
            if(s.start > acc.at or acc.at = 0,
               concat(acc.parts, array(substring(_text, acc.at + 1, s.start - acc.at), '{mask}')), acc.parts) as parts),
        acc -> concat(array_join(acc.parts, ''), substring(_text, acc.at + 1)))"""
    out = found.select("_row", F.expr(f"if(size(_spans) = 0, text, {cleaned})").alias("_clean"), F.size("_spans").alias("_hits"))

    def column(name: str):
        if name == "text":
            return F.col("_clean").alias("text")
        if name == "n_chars":
            return F.expr("if(_hits = 0, _row.n_chars, length(_clean))").cast(documents.schema[name].dataType).alias(name)
        return F.col(f"_row.`{name}`").alias(name)

    return out.select(*map(column, documents.columns))

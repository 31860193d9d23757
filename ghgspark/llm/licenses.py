"""Licence scans: one automaton over words for tags and notice phrases, a shunting-yard parser for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import utf8

#: Phrases (words, lower case) and the label of each; the first four are the base.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"spdx-license-identifier:[\x20\t]*([a-z0-9.+():\x20\t-]*)")

#: Identifiers in expressions and the label of each; a longer name goes by its longest prefix here.
IDENTIFIERS = {
    "0bsd": "bsd", "agpl": "agpl", "apache": "apache", "bsd": "bsd", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl",
}
#: How freely a labelled text may be used, 0 to 1.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "apache": 1.0, "cc-by": 0.9, "mpl": 0.6, "cc-by-sa": 0.5, "lgpl": 0.5,
    "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
               for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: with binds before and, and before or. None if it is no expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand comes next
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token in _STRENGTH:
            if operand:
                return None
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def label_of(identifier: str, identifiers: Mapping[str, str] = IDENTIFIERS) -> str:
    """By the longest known name that the identifier is, or that it continues with - or +."""
    name = identifier.lower()
    while name:
        if name in identifiers:
            return identifiers[name]
        cut = max(name.rfind("-"), name.rfind("+"))
        name = name[:cut] if cut > 0 else ""
    return "other"


def evaluate(expression: str, freedom: Mapping[str, float] = FREEDOM) -> tuple[list[str], float] | None:
    """Labels and freedom of an expression: ``or`` lets one choose the freer side, ``and`` binds to the stricter one,
    an exception after ``with`` leaves its licence as it is. None if it cannot be parsed."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[str, list[str], float]] = []
    for token in order:
        if token in _STRENGTH:
            (_, right_labels, right), (name, labels, left) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((name, labels, left))
            else:
                stack.append(("", labels + right_labels, max(left, right) if token == "or" else min(left, right)))
        else:
            label = label_of(token)
            stack.append((token, [label], freedom.get(label, 0.0)))
    return stack[0][1], stack[0][2]


def tagged(raw: bytes) -> Iterator[tuple[str, list[str], float]]:
    """Every expression behind an identifier tag: as much of its line as can be parsed."""
    for found in TAG_LINE.finditer(raw):
        words = re.findall(r"[()]|[^\s()]+", found[1].decode())
        for n in range(len(words), 0, -1):
            value = evaluate(" ".join(words[:n]))
            if value is not None:
                yield " ".join(words[:n]), *value
                break


def automaton(phrases: Mapping[str, str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in [*phrases, TAG]:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def scan_licenses(documents: DataFrame, base: Mapping[str, str] = BASE_PHRASES,
                  notices: Mapping[str, str] = NOTICE_PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, freedom.

    Words are runs of ASCII letters and digits (lower-cased) and of non-ASCII characters. ``score`` is 1 - 0.5^n for n
    kinds of evidence (labels found, and one more for a tag). ``freedom`` is the lowest of the labels' and the
    expressions' freedom, null without any. A null text is empty: no words, null first and last, empty lists, score 0.
    Each row stands alone: repeated rows repeat, an empty table gives none.
    """
    names = {**notices, **base}
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("expressions", pa.string()), ("freedom", pa.float64())])

    def one(raw: bytes, search: ahocorasick.Automaton) -> tuple:
        words = raw.translate(_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        text = line.decode("latin-1")
        at, tag, labels, base_labels = [], False, set(), set()
        for end, phrase in search.iter(text):
            if phrase == TAG:
                tag = True
                continue
            labels.add(names[phrase])
            if phrase in base:
                base_labels.add(base[phrase])
                at.append(line.count(b" ", 0, end - len(phrase) - 1))  # blanks before the one that opens the match
        expressions = list(tagged(raw.translate(_LOWER))) if tag else []
        free = [FREEDOM.get(x, 0.0) for x in labels] + [x[2] for x in expressions]
        for _, found, _ in expressions:
            labels.update(found)
        evidence = len(labels) + bool(expressions)
        return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
                ",".join(sorted(labels)), 1 - 0.5**evidence, "; ".join(x[0] for x in expressions), min(free, default=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton(names)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw, offsets = data.tobytes(), offsets.tolist()
            rows = [one(raw[a:b], search) for a, b in zip(offsets, offsets[1:])]
            columns = zip(*rows) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()),
                 *(pa.array(c, t) for c, t in zip(columns, schema.types[1:]))], schema=schema)

    types = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, expressions string, freedom double")
    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, types)

"""String columns: trimming, folding, field extraction and number rendering."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII_SPACE = " \t\n\r\x0b\x0c"
_OTHER_SPACE = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITE_SPACE = _ASCII_SPACE + _OTHER_SPACE


def strip(c: Column) -> Column:
    """Trim all Unicode white space (``trim`` removes only U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def has_wide_space(c: Column) -> Column:
    """True where the text holds white space that a plain ``\\s`` does not match."""

    def any_of(text: Column, characters: str) -> Column:
        return reduce(or_, [F.contains(text, F.lit(space)) for space in characters])

    # Plain byte searches: of all text for the four control characters, of what is not ASCII for the others.
    others = F.regexp_replace(c, r"[\x00-\x7f]+", "")
    return any_of(c, _OTHER_SPACE[:4]) | ((F.octet_length(c) != F.char_length(c)) & any_of(others, _OTHER_SPACE[4:]))


def field_pattern(pattern: str, wide: bool = False) -> str:
    """A label pattern for Java's engine: any case, "." stopping only at a line feed.

    Unicode classes slow the search down several times, so they are asked for (``wide``) only
    in texts that have unusual white space.
    """
    if wide:
        return "(?iUd)" + pattern
    return "(?id)" + pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace("[äa]", "[äÄa]")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def fold_umlauts(c: Column, accents: bool = False) -> Column:
    """ä, ö, ü to ae, oe, ue; with ``accents`` also é to e. Expects lower case."""
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        c = F.replace(c, F.lit(umlaut), F.lit(plain))
    return F.replace(c, F.lit("é"), F.lit("e")) if accents else c


def header_key(c: Column) -> Column:
    """A header cell reduced to its comparable form."""
    bare = F.btrim(strip(c), F.lit("\ufeff"))
    return fold_umlauts(F.lower(bare), accents=True)


def required_words(pattern: str) -> list[str]:
    """Plain words every match of a label pattern contains; none where that is not certain."""
    label = pattern.split("(")[0]
    if "|" in label:
        return []
    bare = re.sub(r"\[[^\]]*\][*+?]?|\\.[*+?]?", " ", label)
    return [word.lower() for word in re.findall(r"[A-Za-z]+(?=[^A-Za-z?*{]|$)", bare)]


def first_group(text: Column, patterns: Sequence[str], low: Column, wide: Column, group: int = 1) -> Column:
    """Group of the first pattern that matches, trimmed; null when none does.

    ``low`` is the lower-cased text and ``wide`` tells whether it has unusual white space. A
    text without a pattern's plain words (a byte search) is not searched for that pattern. The
    match is made to swallow the rest of the text, so there is one match to take at most, and
    a miss is null without naming the search twice.
    """

    def found(pattern: str) -> Column:
        def search(regex: str) -> Column:
            return F.get(F.regexp_extract_all(text, F.lit(regex + "(?s:.*)"), F.lit(group)), 0)

        words = [F.contains(low, F.lit(word)) for word in required_words(pattern)]
        return F.when(wide, search(field_pattern(pattern, True))).when(
            reduce(and_, words, F.lit(True)), search(field_pattern(pattern))
        )

    return strip(F.coalesce(*[found(p) for p in patterns]))


def first_line(text: Column) -> Column:
    """The first line holding anything but white space, trimmed."""
    in_line = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    return strip(F.regexp_substr(strip(text), F.lit(f"^{in_line}+")))


def german_date_to_iso(c: Column) -> Column:
    """``DD.MM.YYYY`` to ``YYYY-MM-DD``; any other shape is returned unchanged."""
    return F.regexp_replace(c, r"^([^.]*)\.([^.]*)\.([^.]*)$", "$3-$2-$1")


def or_default(c: Column, default: Column | str) -> Column:
    """``default`` where the text is null or empty."""
    return F.coalesce(blank_to_null(c), F.lit(default) if isinstance(default, str) else default)


def number_or_default(c: Column, default: str) -> Column:
    """Number as text, with null **and zero** taking the default."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(float_text(c))


def _decimal_text(c: Column, scale: int) -> Column:
    return F.regexp_replace(c.try_cast(f"decimal(38,{scale})").cast("string"), r"0+$", "")


def float_text(c: Column) -> Column:
    """Shortest text of a double: ``478800.0``, ``0.1``, ``1e-05``, ``1e+16``."""
    raw = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    exponent = F.substring_index(raw, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    plain_large = F.regexp_replace(_decimal_text(c, 10), r"\.$", ".0")
    plain_small = _decimal_text(c, 30)
    return (
        F.when(~F.contains(raw, F.lit("E")), raw)
        .when((exponent >= 0) & (exponent < 16), plain_large)
        .when((exponent < 0) & (exponent >= -4), plain_small)
        .otherwise(scientific)
    )


def fixed_text(c: Column, digits: int = 2, signed: bool = False) -> Column:
    """Fixed-point text of the exact binary value, ties to even, for magnitudes below 1e12.

    ``format_string`` rounds the shortest decimal form half up. The two differ only where
    that form ends in a 5 after the last kept digit, so there the error of scaling by a power
    of ten (taken exactly by splitting the double in two halves) decides.
    """
    scale = float(10 ** (digits + 1))
    magnitude = F.abs(c)
    scaled = magnitude * scale
    carry = magnitude * 134217729.0
    high = carry - (carry - magnitude)
    error = (high * scale - scaled) + (magnitude - high) * scale
    nearest = F.rint(scaled)
    residue = (scaled - nearest) + error
    on_tie = (F.pmod(nearest, F.lit(10.0)) == 5.0) & (F.abs(scaled - nearest) < 0.01)
    below = (nearest - 5.0) / 10.0
    up = (residue > 0) | ((residue == 0) & (F.pmod(below, F.lit(2.0)) == 1.0))
    nudged = F.when(on_tie, (below + F.when(up, 1.0).otherwise(0.0)) / float(10**digits)).otherwise(magnitude)
    body = F.format_string(f"%.{digits}f", nudged)
    negative = (c < 0) | (c.cast("string") == "-0.0")
    sign = F.when(negative, "-").otherwise("+" if signed else "")
    # format_string renders null as text.
    return F.when(c.isNotNull(), F.concat(sign, body))

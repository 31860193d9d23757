"""Text to number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ghgspark.functions.text import strip

GERMAN, ENGLISH = "german", "english"

# What try_cast reads but is no number: '1d', 'nan', 'inf'.
_NOT_A_NUMBER = r"[A-DF-Za-df-z]"


def _guarded(c: Column) -> Column:
    value = F.when(~c.rlike(_NOT_A_NUMBER), c.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def clean_number(c: Column) -> Column:
    """Drop thousands commas and read a double; junk, NaN and infinities give null."""
    return _guarded(strip(F.replace(c.cast("string"), F.lit(","), F.lit(""))))


def locale_number(c: Column, number_format: Column | str, strict_locale: bool = False) -> Column:
    """Read a number in the file's format.

    German drops dots and reads the comma as decimal point, English drops commas. With
    ``strict_locale`` a cell that can only be English (``1,234.56``) is read as English
    whatever the format of its file.
    """
    fmt = F.lit(number_format) if isinstance(number_format, str) else number_format
    german = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(c, F.lit(","), F.lit(""))
    is_german = fmt == GERMAN
    if strict_locale:
        is_german = is_german & ~c.rlike(r"^\s*[+-]?\d{1,3}(?:,\d{3})+\.\d+\s*$")
    return _guarded(strip(F.when(is_german, german).otherwise(english)))


def number_format_of(cells: Column) -> Column:
    """Number format told by the first cell that decides; German when none does."""
    return F.coalesce(number_vote(cells), F.lit(GERMAN))


def number_vote(cells: Column) -> Column:
    """Number format told by the first cell that decides, null when none does."""
    compact = F.transform(cells, lambda c: F.replace(strip(c), F.lit(" "), F.lit("")))
    votes = F.transform(
        compact,
        lambda c: F.when(c.rlike(r"^[\d.,]*,\d*$"), GERMAN).when(c.rlike(r"^[\d.]*\.\d{0,2}$"), ENGLISH),
    )
    return F.try_element_at(F.filter(votes, lambda v: v.isNotNull()), F.lit(1))


def to_double(c: Column) -> Column:
    """Metadata value to double, null where it is not a number."""
    return _guarded(strip(c.cast("string")))


def exact(c: Column, scale: int = 8) -> Column:
    """Decimal view of a double, so that sums do not depend on their order; null beyond its range."""
    return c.try_cast(f"decimal(28,{scale})")


def exact_sum(c: Column, scale: int = 8) -> Column:
    """Sum as a double. Decimal, so that it does not depend on the rows' order, as long as every value and the sum fit;
    a plain sum of doubles otherwise."""
    fits = F.count(exact(c, scale)) == F.count(c)
    return F.coalesce(F.when(fits, F.try_sum(exact(c, scale))).cast("double"), F.sum(c))

"""Billing periods as ``YYYY-MM`` text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ghgspark.constants import ENGLISH_MONTHS, FIRST_YEAR, GERMAN_MONTHS, LAST_YEAR
from ghgspark.functions.text import fold_umlauts, strip

# One alternative per accepted shape; the replacement below joins whichever groups matched.
_SHAPES = (
    r"^(?:(\d{4})-(\d{2})"
    r"|(\d{2})\.(\d{4})"
    r"|(\d{4})(\d{2})"
    r"|P?(\d{2})/(\d{4})"
    r"|([A-Za-zäöü]+)(?U:\s)+(\d{4}))$"
)
_YEAR_THEN_MONTH = "$1$4$5$8$10-$2$3$6$7$9"


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def month_number(name: Column) -> Column:
    """Two-digit month of a German (umlauts folded) or English (as written) name."""
    key = F.lower(name)
    return F.coalesce(
        F.try_element_at(_literal_map(GERMAN_MONTHS), fold_umlauts(key)),
        F.try_element_at(_literal_map(ENGLISH_MONTHS), key),
    )


def normalize_period(c: Column) -> Column:
    """``YYYY-MM`` from any accepted shape; null outside the year and month ranges."""
    text = strip(c)
    ordered = F.regexp_replace(text, _SHAPES, _YEAR_THEN_MONTH)
    year, month = F.substring(ordered, 1, 4), F.substring(ordered, 6, 32)
    digits = F.when(month.rlike(r"^\d"), month).otherwise(month_number(month))
    valid = year.try_cast("int").between(FIRST_YEAR, LAST_YEAR) & digits.try_cast("int").between(1, 12)
    return F.when(text.rlike(_SHAPES) & valid, F.concat(year, F.lit("-"), digits))


def month_span(start: Column, end: Column) -> Column:
    """Months between two ``YYYY-MM…`` texts, null when either is not of that form."""

    def part(c: Column, n: int) -> Column:
        return F.get(F.split(c, "-"), n).try_cast("int")

    return (part(end, 0) - part(start, 0)) * 12 + (part(end, 1) - part(start, 1))

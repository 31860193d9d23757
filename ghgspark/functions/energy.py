"""Energy types and units."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ghgspark.constants import (
    DEFAULT_UNIT,
    EXPORT_ENERGY_KEYWORDS,
    INVOICE_ENERGY_KEYWORDS,
    KWH_PER_M3_GAS,
    KWH_PER_MWH,
    UNIT_NAMES,
)
from ghgspark.functions.text import fold_umlauts, strip


def export_energy_type(c: Column, keywords: Sequence[tuple[str, str]] = EXPORT_ENERGY_KEYWORDS) -> Column:
    """Canonical type of the first keyword found in the cell, else ``unknown``."""
    folded = fold_umlauts(F.lower(c))
    found = None
    for word, energy_type in keywords:
        hit = F.contains(folded, F.lit(word))
        found = F.when(hit, energy_type) if found is None else found.when(hit, energy_type)
    return F.coalesce(found, F.lit("unknown"))


def invoice_energy_type(
    c: Column,
    keywords: Sequence[tuple[str, Sequence[str]]] = INVOICE_ENERGY_KEYWORDS,
    lowered: Column | None = None,
) -> Column:
    """Canonical type of the first keyword list with a hit, else the raw text.

    ``lowered`` may hold the lower-cased text if the caller has it at hand.
    """
    lowered = F.lower(c) if lowered is None else lowered
    found = None
    for energy_type, words in keywords:
        hit = F.contains(lowered, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(lowered, F.lit(word))
        found = F.when(hit, energy_type) if found is None else found.when(hit, energy_type)
    return found.otherwise(c)


def unit_name(c: Column, names: dict[str, str] = UNIT_NAMES) -> Column:
    """Canonical unit; blank means kWh, an unknown unit is kept as written."""
    bare = strip(c)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(DEFAULT_UNIT)).otherwise(
        F.coalesce(F.try_element_at(known, F.lower(bare)), bare)
    )


def to_base_unit(amount: Column, unit: Column) -> Column:
    """MWh and m3 to kWh; every other unit is left alone."""
    return (
        F.when(unit == "MWh", amount * KWH_PER_MWH)
        .when(unit == "m3", amount * KWH_PER_M3_GAS)
        .otherwise(amount)
    )

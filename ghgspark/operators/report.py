"""B3 energy and emissions report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ghgspark.constants import (
    MAX_REPORT_MONTHS,
    MWH_PER_LITRE_DIESEL,
    REPORT_GATES,
    REPORT_RANGES,
    SCOPE_OF_ENERGY_TYPE,
)
from ghgspark.functions import exact, exact_sum, fixed_text, month_span, strip

_KNOWN_TYPES = tuple(SCOPE_OF_ENERGY_TYPE)


def totals_by_type(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Consumption and emissions per energy type; untyped records dropped, empty sums zero."""
    return (
        records.where(F.col("energy_type").isNotNull())
        .groupBy(*by, "energy_type")
        .agg(
            F.coalesce(exact_sum(F.col("consumption_kwh")), F.lit(0.0)).alias("consumption_kwh"),
            F.coalesce(exact_sum(F.col("emissions_tco2")), F.lit(0.0)).alias("emissions_tco2"),
        )
    )


def unknown_types(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One warning row per energy type outside both scopes, with the excluded consumption."""
    outside = records.where(~F.col("energy_type").isin(*_KNOWN_TYPES))
    return totals_by_type(outside, by).select(
        *by, "energy_type", "consumption_kwh", _excluded(F.col("energy_type"), F.col("consumption_kwh")).alias("warning")
    )


def _excluded(energy_type: Column, consumption: Column) -> Column:
    return F.concat(
        F.lit("Unknown energy type '"), energy_type, F.lit("' with "), fixed_text(consumption, 1),
        F.lit(" consumption excluded from MWh total"),
    )


def _period_bounds() -> tuple[Column, Column]:
    start, end = (
        F.when(strip(F.col(c)) != "", F.col(c)) for c in ("billing_period_from", "billing_period_to")
    )
    # least and greatest skip nulls.
    return F.min(F.least(start, end)), F.max(F.greatest(start, end))


def report(records: DataFrame, by: Sequence[str] = (), turnover: float | None = None) -> DataFrame:
    """One row per combination of ``by`` (one row in all without it).

    Records are summed by type first, then by ``by``: partial aggregates in both steps, no shuffle of records and no
    key wide enough to be skewed. Sums are decimal, so they do not depend on row order; where a value or a sum is
    beyond the decimals' range the sum of doubles takes over and a warning says so. Warnings name the unknown types
    (in order), then the values out of range, then the periods.
    """
    kind = F.col("energy_type")
    start, end = _period_bounds()
    by_type = records.groupBy(*by, "energy_type").agg(
        F.count("*").alias("n"), start.alias("first_period"), end.alias("last_period"),
        *[x for name in ("consumption_kwh", "emissions_tco2") for x in (
            F.when(F.count(exact(F.col(name))) == F.count(name), F.coalesce(F.try_sum(exact(F.col(name))), F.lit(0)))
            .alias(f"{name}_exact"),
            F.coalesce(F.sum(name), F.lit(0.0)).alias(f"{name}_double"))],
    )
    scopes = {f"scope{s}": [t for t, own in SCOPE_OF_ENERGY_TYPE.items() if own == s] for s in (1, 2)}
    totals = {"electricity": ("consumption_kwh", ["electricity"]), "gas": ("consumption_kwh", ["natural_gas"]),
              "diesel": ("consumption_kwh", ["diesel"]), **{k: ("emissions_tco2", v) for k, v in scopes.items()}}

    def chosen(name: str, how: str) -> Column:
        return F.when(kind.isin(*totals[name][1]), F.col(f"{totals[name][0]}_{how}"))

    def in_range(name: str) -> Column:
        return F.coalesce(F.bool_and(chosen(name, "exact").isNotNull() | ~F.coalesce(kind.isin(*totals[name][1]), F.lit(False))), F.lit(True))

    unknown = F.when(kind.isNotNull() & ~kind.isin(*_KNOWN_TYPES), F.struct(
        "energy_type", _excluded(kind, F.coalesce(F.col("consumption_kwh_exact").cast("double"), "consumption_kwh_double")).alias("text")))
    sums = by_type.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_count"),
        F.min("first_period").alias("first_period"), F.max("last_period").alias("last_period"),
        # As many as there are unknown types.
        F.transform(F.array_sort(F.collect_list(unknown)), lambda u: u["text"]).alias("unknown"),
        *[x for name in totals for x in (
            F.when(in_range(name), F.coalesce(F.try_sum(chosen(name, "exact")), F.lit(0))).alias(name),
            F.coalesce(F.sum(chosen(name, "double")), F.lit(0.0)).alias(f"{name}_double"))],
    )
    factors = {"electricity": "0.001", "gas": "0.001", "diesel": str(MWH_PER_LITRE_DIESEL)}

    def scaled(name: str) -> Column:
        places = len(factors[name]) - 2
        return F.col(name) * F.lit(factors[name]).cast(f"decimal({places + 1},{places})")

    def rounded(value: Column, other: Column) -> Column:
        return F.coalesce(F.round(value, 2).cast("double"), F.round(other, 2))

    energy = {
        f"{name}_mwh": (scaled(name), F.col(f"{name}_double") * float(factor)) for name, factor in factors.items()
    }
    total_mwh = [reduce(lambda x, y: x + y, side) for side in zip(*energy.values())]
    too_large = reduce(lambda x, y: x | y, [F.col(name).isNull() for name in totals])
    months = month_span(F.col("first_period"), F.col("last_period"))
    return sums.select(
        *by,
        "records_count",
        F.coalesce("first_period", F.lit("unknown")).alias("period_start"),
        F.coalesce("last_period", F.lit("unknown")).alias("period_end"),
        *[rounded(*v).alias(name) for name, v in energy.items()],
        rounded(*total_mwh).alias("total_energy_mwh"),
        rounded(F.col("scope1"), F.col("scope1_double")).alias("scope1_tco2eq"),
        rounded(F.col("scope2"), F.col("scope2_double")).alias("scope2_tco2eq"),
        F.lit(turnover).cast("double").alias("turnover_eur"),
        F.concat("unknown", F.array_compact(
            F.array(
                F.when(too_large, F.lit("Values beyond the exact range, summed as floating-point numbers")),
                F.when(F.col("first_period").isNull(), F.lit("No billing period data found in CSV")),
                F.when(
                    months > MAX_REPORT_MONTHS,
                    F.concat(
                        F.lit("Data spans "), months.cast("string"), F.lit(" months ("), F.col("first_period"),
                        F.lit(" to "), F.col("last_period"),
                        F.lit("). VSME is annual reporting. Consider filtering input."),
                    ),
                ),
            )
        )).alias("warnings"),
    )


def period_range(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last billing period (as text) and the months between them."""
    start, end = _period_bounds()
    return (
        records.groupBy(*by)
        .agg(start.alias("first"), end.alias("last"))
        .select(
            *by,
            F.coalesce("first", F.lit("unknown")).alias("period_start"),
            F.coalesce("last", F.lit("unknown")).alias("period_end"),
            month_span(F.col("first"), F.col("last")).alias("months"),
        )
    )


def named_values(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Report rows in long form: ``named_range, value_double, value_bool``.

    The turnover row appears only where a turnover was given; the last rows are the gates.
    """
    zero = F.lit(0.0)
    values = (
        (REPORT_RANGES["total"], F.col("total_energy_mwh")),
        (REPORT_RANGES["electricity"], F.col("electricity_mwh")),
        (REPORT_RANGES["electricity_renewable"], zero),
        (REPORT_RANGES["self_renewable"], zero),
        (REPORT_RANGES["self_non_renewable"], zero),
        (REPORT_RANGES["scope1"], F.col("scope1_tco2eq")),
        (REPORT_RANGES["scope2"], F.col("scope2_tco2eq")),
        (REPORT_RANGES["turnover"], F.col("turnover_eur")),
    )

    def entry(name: str, number: Column, flag: Column) -> Column:
        return F.struct(
            F.lit(name).alias("named_range"), number.cast("double").alias("value_double"),
            flag.cast("boolean").alias("value_bool"),
        )

    rows = [entry(name, number, F.lit(None)) for name, number in values]
    rows += [entry(name, F.lit(None), F.lit(flag)) for name, flag in REPORT_GATES]
    return (
        reports.select(*by, F.explode(F.array(*rows)).alias("v"))
        .select(*by, "v.*")
        .where(F.col("value_double").isNotNull() | F.col("value_bool").isNotNull())
    )


def has_required_columns(frame: DataFrame) -> None:
    """Raise unless the columns the report needs are there."""
    missing = {"energy_type", "consumption_kwh", "emissions_tco2"} - set(frame.columns)
    if missing:
        raise ValueError(f"CSV missing required columns: {sorted(missing)}")

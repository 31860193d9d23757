"""Column builders. No function here needs a Python UDF."""

from ghgspark.functions.energy import export_energy_type, invoice_energy_type, to_base_unit, unit_name
from ghgspark.functions.numbers import (
    clean_number,
    exact,
    exact_sum,
    locale_number,
    number_format_of,
    number_vote,
    to_double,
)
from ghgspark.functions.periods import month_number, month_span, normalize_period
from ghgspark.functions.text import (
    blank_to_null,
    first_group,
    first_line,
    fixed_text,
    float_text,
    fold_umlauts,
    german_date_to_iso,
    has_wide_space,
    header_key,
    number_or_default,
    or_default,
    strip,
)

__all__ = [
    "blank_to_null", "clean_number", "exact", "exact_sum", "export_energy_type", "first_group", "first_line",
    "fixed_text", "float_text", "fold_umlauts", "german_date_to_iso", "has_wide_space", "header_key",
    "invoice_energy_type", "locale_number", "month_number", "month_span", "normalize_period",
    "number_format_of", "number_or_default", "number_vote", "or_default", "strip", "to_base_unit", "to_double",
    "unit_name",
]

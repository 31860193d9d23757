"""Emission factors as a dimension table."""

from __future__ import annotations

import logging
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.constants import EMISSION_FACTORS, FACTOR_OF_ENERGY_TYPE
from ghgspark.schemas import FACTORS

logger = logging.getLogger(__name__)

_ENTRY = "struct<value:double,unit:string,source:string,year:int,note:string,energy_type:string>"


def default_factors(spark: SparkSession) -> DataFrame:
    """The built-in factors as inline rows, whose exact size lets Catalyst broadcast them."""

    def literal(value: str | int | float) -> str:
        if isinstance(value, str):
            return f"'{value}'"
        return f"{value!r}D" if isinstance(value, float) else repr(value)

    rows = ", ".join(f"({', '.join(map(literal, row))})" for row in EMISSION_FACTORS)
    names = ", ".join(column.split()[0] for column in FACTORS.split(", "))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS factors({names})")


def load_factors(spark: SparkSession, path: str) -> DataFrame:
    """Factors of a JSON object of name to entry.

    A missing file, malformed JSON or an entry without value, unit, source or year gives an
    empty set. ``note`` defaults to ''. An entry may name its ``energy_type``, so that new types come with
    the file; without it the built-in names have theirs.
    """
    try:
        documents = spark.read.text(path, wholetext=True)
    except AnalysisException:
        logger.warning("Emission factors file not found: %s", path)
        return spark.createDataFrame([], FACTORS)
    entries = documents.select(F.from_json("value", f"map<string,{_ENTRY}>").alias("entries"))

    def complete(entry):
        return (
            entry["value"].isNotNull() & entry["unit"].isNotNull()
            & entry["source"].isNotNull() & entry["year"].isNotNull()
        )

    types = {name: energy_type for energy_type, name in FACTOR_OF_ENERGY_TYPE.items()}
    type_of = F.create_map(*[F.lit(x) for x in chain.from_iterable(types.items())])
    return (
        entries.where(F.forall(F.map_values("entries"), complete))
        .select(F.explode("entries").alias("name", "entry"))
        .select(
            "name",
            F.coalesce("entry.energy_type", F.try_element_at(type_of, F.col("name"))).alias("energy_type"),
            "entry.value", "entry.unit", "entry.source", "entry.year",
            F.coalesce("entry.note", F.lit("")).alias("note"),
        )
    )

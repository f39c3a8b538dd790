"""Properties from long tables: one row for each id with the value columns of the wanted properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.functions.predicates import Kind

#: Value columns of each property: their suffixes.
PARTS = {"string_value": "__string", "numeric_value": "__numeric", "string_values": "__strings", "numeric_values": "__numerics"}


def value_column(kind: Kind) -> str:
    return "string_value" if kind.is_text else "numeric_value"


def array_column(kind: Kind) -> str:
    return value_column(kind) + "s"


def _restricted(props: DataFrame, key: str, names: Sequence[str], ids: DataFrame | None) -> DataFrame:
    rows = props.where(F.col("property_name").isin(*names))
    return rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_semi")


def load(props: DataFrame, key: str, kinds: dict[str, Kind], ids: DataFrame | None = None) -> DataFrame:
    """For each id that has one of the properties: its scalar in <p> and its array in <p>__array, by declared kind. Of several values the largest."""
    rows = _restricted(props, key, list(kinds), ids)
    picked = [F.max(F.when(F.col("property_name") == p, F.col(c))).alias(a) for p, k in kinds.items() for c, a in ((value_column(k), p), (array_column(k), f"{p}__array"))]
    return rows.groupBy(key).agg(*picked)


def load_untyped(props: DataFrame, key: str, names: Sequence[str], ids: DataFrame | None = None, parts: Sequence[str] = ("string_value", "numeric_value")) -> DataFrame:
    """For each id that has one of the properties: <p>__string, <p>__numeric (and the arrays, if asked for)."""
    rows = _restricted(props, key, list(names), ids)
    picked = [F.max(F.when(F.col("property_name") == p, F.col(c))).alias(p + PARTS[c]) for p in names for c in parts]
    return rows.groupBy(key).agg(*picked)


def valid_at(props: DataFrame, moment: str) -> DataFrame:
    """Dynamic properties whose window holds the moment; an open bound, or one that no record has, holds always."""
    at, always = F.lit(moment).cast("timestamp"), F.lit(True)
    begun = F.col("`from`").isNull() | (F.col("`from`") <= at) if "from" in props.columns else always
    return props.where(begun & (F.col("`to`").isNull() | (F.col("`to`") > at) if "to" in props.columns else always))

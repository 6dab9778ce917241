"""Type suggestions from the share of values that parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.parsing import to_moment
from sightline.functions.tablestats import TableStats
from sightline.types import GEO_WORDS, col, name_has, small_frame

CONVERT_ABOVE = 0.8
CATEGORY_BELOW = 0.1


def suggested_type(s: TableStats, name: str) -> str | None:
    """'numeric' or 'datetime' when more than 80 % of all rows convert."""
    numbers, moments = s.parse_counts[name]
    if s.rows and numbers / s.rows > CONVERT_ABOVE:
        return "numeric"
    if s.rows and moments / s.rows > CONVERT_ABOVE:
        return "datetime"
    return None


def suggest_types(table) -> DataFrame:
    """Current and suggested type with the reason, for every column."""
    s = TableStats.of(table)
    rows = []
    for f in s.df.schema.fields:
        current = f.dataType.simpleString()
        row = (f.name, current, current, None, "No change needed")
        if f.name in s.strings and s.rows:
            kind = suggested_type(s, f.name)
            if kind:
                ratio = s.parse_counts[f.name][0 if kind == "numeric" else 1] / s.rows
                row = (f.name, current, kind, ratio, f"{ratio:.1%} values can be converted to {kind}")
            else:
                ratio = s.values[f.name].unique / s.rows
                if ratio < CATEGORY_BELOW:
                    row = (f.name, current, "category", ratio,
                           f"Only {ratio:.1%} unique values - good candidate for categorical")
        rows.append(row)
    return small_frame(s.spark, rows, "column string, current_type string, suggested_type string, ratio double, "
                       "reason string")


def type_conversion_suggestions(table) -> DataFrame:
    """Looser list: numeric if any value converts, datetime if more than half of the rows do."""
    s = TableStats.of(table)
    rows = []
    for c in s.strings:
        numbers, moments = s.parse_counts[c]
        if numbers:
            rows.append((c, "string", "numeric", numbers, f"Can convert {numbers} values to numeric"))
        if s.rows and moments > 0.5 * s.rows:
            rows.append((c, "string", "datetime", moments, f"Can convert {moments} values to datetime"))
    return small_frame(s.spark, rows, "column string, current_type string, suggested_type string, "
                       "convertible bigint, reason string")


def numeric_columns(table, min_fraction: float = 0.8) -> DataFrame:
    """Numeric columns, and text columns whose non-null values convert to numbers often enough."""
    s = TableStats.of(table)
    rows = []
    for f in s.df.schema.fields:
        if f.name in s.numeric:
            rows.append((f.name, "numeric", 1.0))
        elif f.name in s.strings and s.rows:
            fraction = s.parse_counts[f.name][0] / s.rows
            if fraction >= min_fraction:
                rows.append((f.name, "numeric-like", fraction))
    return small_frame(s.spark, rows, "column string, kind string, fraction double")


def date_column_names(table) -> list[str]:
    s = TableStats.of(table)
    if not s.strings:
        return []
    bad = s.df.agg(*[F.count_if(col(c).isNotNull() & to_moment(col(c)).isNull()).alias(f"b{i}")
                     for i, c in enumerate(s.strings)]).first()
    return [c for i, c in enumerate(s.strings) if bad[f"b{i}"] == 0 and s.non_null[c] > 0]


def detect_date_columns(table) -> DataFrame:
    """Text columns of which every value reads as a date."""
    s = TableStats.of(table)
    return small_frame(s.spark, [(c, s.non_null[c]) for c in date_column_names(s)],
                       "column string, value_count bigint")


def geo_column_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if name_has(c, GEO_WORDS)]


def detect_geo_columns(table) -> DataFrame:
    """Columns whose name speaks of places, with the role latitude or longitude where it fits."""
    s = TableStats.of(table)
    rows = [(c, "lat" in c.lower(), "lon" in c.lower(), s.non_null[c]) for c in geo_column_names(s.df)]
    return small_frame(s.spark, rows, "column string, latitude boolean, longitude boolean, value_count bigint")

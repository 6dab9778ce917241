"""Row and column selection; all narrow, so filters and columns reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.counts import row_hash
from sightline.types import col, num, numeric_names, require, string_names

WIDE = 20
WIDE_NUMERIC, WIDE_STRING = 15, 5


def preview(df: DataFrame, n: int = 10, how: str = "head", order_by: list[str] | None = None) -> DataFrame:
    """First or last n rows in the order of the given columns (all columns by default)."""
    if how not in ("head", "tail"):
        raise ValueError("how must be 'head' or 'tail'")
    keys = [col(c) for c in (order_by or df.columns)]
    return df.orderBy(*[k.asc_nulls_last() if how == "head" else k.desc_nulls_first() for k in keys]).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the rows with the smallest seeded hash, the same on every run."""
    keyed = df.withColumn("_h", F.xxhash64(F.lit(seed), row_hash(df)))
    return keyed.orderBy("_h", *[col(c) for c in df.columns]).limit(n).drop("_h")


def limit_columns(df: DataFrame, most: int = WIDE) -> DataFrame:
    """Of a wide table keep the first 15 numeric and the first 5 text columns."""
    if len(df.columns) <= most:
        return df
    return df.select(*[col(c) for c in numeric_names(df)[:WIDE_NUMERIC] + string_names(df)[:WIDE_STRING]])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    require(df, *names)
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    if new != old and new in df.columns:
        raise ValueError(f"column {new!r} exists already")
    return df.withColumnRenamed(old, new)


def _isin(name: str, values, keep_null: bool) -> Column:
    kept = [v for v in values if v is not None]
    test = col(name).isin(kept) if kept else F.lit(False)
    return (test | col(name).isNull()) if keep_null or None in values else test


def filter_isin(df: DataFrame, name: str, values: list, keep_null: bool = False) -> DataFrame:
    """Rows whose value is listed; nulls only when asked for or listed."""
    require(df, name)
    return df.filter(_isin(name, values, keep_null))


def filter_range(df: DataFrame, name: str, low, high) -> DataFrame:
    """Rows with low <= value <= high; nulls fall out."""
    require(df, name)
    return df.filter(col(name).between(low, high))


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """One conjunction of ``{column: [values] | (low, high)}``."""
    require(df, *filters)
    tests = [col(c).between(*f) if isinstance(f, tuple) else _isin(c, f, False) for c, f in filters.items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_report(df: DataFrame, filters: dict) -> DataFrame:
    """Rows before and after the filters, in one scan."""
    require(df, *filters)
    tests = [col(c).between(*f) if isinstance(f, tuple) else _isin(c, f, False) for c, f in filters.items()]
    kept = reduce(lambda a, b: a & b, tests, F.lit(True))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"),
                  F.lit(len(df.columns)).alias("column_count"))


def filter_domain_range(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with a latitude in [-90, 90] and a longitude in [-180, 180]."""
    return df.filter(num(lat).between(-90, 90) & num(lon).between(-180, 180))

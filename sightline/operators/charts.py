"""Projections and dispatchers that feed charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.parsing import to_moment, to_number
from sightline.operators import correlation, distribution, groups
from sightline.types import col, is_numeric, is_string, num, numeric_names, require


def _number(df: DataFrame, name: str) -> Column:
    return to_number(col(name)) if is_string(df.schema[name].dataType) else num(name)


def line_data(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """x, y as a number and the series, in x order within each series."""
    require(df, x, y, *([color] if color else []))
    series = [col(color).alias("series")] if color else []
    out = df.select(*series, col(x).alias("x"), _number(df, y).alias("y")).filter("x is not null and y is not null")
    return out.orderBy(*(["series"] if color else []), "x", "y")


def scatter_data(df: DataFrame, x: str, y: str, z: str | None = None, color: str | None = None,
                 size: str | None = None) -> DataFrame:
    """Coordinates, category and marker size (value over its maximum, scaled to 5..25, per category if coloured)."""
    require(df, *[c for c in (x, y, z, color, size) if c])
    out = df.select(num(x).alias("x"), num(y).alias("y"), *([num(z).alias("z")] if z else []),
                    *([col(color).alias("category")] if color else []), *([num(size).alias("_s")] if size else []))
    if color:
        out = out.filter("category is not null")
    if not size:
        return out.withColumn("marker_size", F.lit(8.0))
    if color:
        # the maximum per category is pre-aggregated map-side and met in an equi-join: no group in one task
        top = out.groupBy("category").agg(F.max("_s").alias("_m"))
        out = out.join(top, "category")
    else:
        out = out.join(F.broadcast(out.agg(F.max("_s").alias("_m"))))  # one row
    return out.withColumn("marker_size", F.try_divide(F.col("_s"), F.col("_m")) * 20 + 5).drop("_s", "_m")


def scatter_matrix_data(df: DataFrame, names: list[str]) -> DataFrame:
    if len(names) < 2:
        raise ValueError("give at least two columns")
    require(df, *names)
    return df.select(*[col(c) for c in names])


def rug_data(df: DataFrame, name: str) -> DataFrame:
    """Non-null values."""
    require(df, name)
    return df.select(num(name).alias("value")).filter("value is not null")


def time_series(df: DataFrame, date: str, value: str, bucket: str | None = None) -> DataFrame:
    """Value over time, in time order; with ``bucket`` (day, month, ...) the mean and count per period."""
    require(df, date, value)
    when = to_moment(col(date)) if is_string(df.schema[date].dataType) else col(date).cast("timestamp_ntz")
    points = df.select(when.alias("moment"), _number(df, value).alias("value")).filter("moment is not null")
    if bucket is None:
        return points.orderBy("moment", "value")
    return points.groupBy(F.date_trunc(bucket, "moment").cast("timestamp_ntz").alias("period")).agg(
        F.avg("value").alias("mean_value"), F.count("value").alias("value_count"))


def bivariate(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two columns by their kinds: line and correlation, boxes per category, or a cross table."""
    require(df, x, y)
    numeric = [is_numeric(df.schema[c].dataType) for c in (x, y)]
    if all(numeric):
        return correlation.ols_trend(df, x, y).join(F.broadcast(correlation.correlation(df, x, y)))  # one row each
    if any(numeric):
        value, category = (x, y) if numeric[0] else (y, x)
        return distribution.box_stats(df, value, category)
    return groups.crosstab_long(df, x, y)


def chart_data(df: DataFrame, spec: dict) -> DataFrame | None:
    """The table behind one chart of a specification; None where the reference draws nothing."""
    kind = spec.get("type", "bar")
    x, y, color = (spec.get(k) for k in ("x_column", "y_column", "color_column"))
    has_x, has_y = bool(x) and x in df.columns, bool(y) and y in df.columns
    color = color if color and color in df.columns else None
    if kind == "bar":
        if has_x and has_y:
            return line_data(df, x, y, color)
        if has_x:
            return groups.value_counts(df, x, 10) if is_string(df.schema[x].dataType) else _histogram(df, x)
    elif kind == "histogram" and has_x:
        return _histogram(df, x)
    elif kind == "line" and has_x and has_y:
        return line_data(df, x, y, color)
    elif kind == "pie" and has_x:
        return groups.value_counts(df, x, 8)
    elif kind == "scatter" and has_x and has_y:
        return scatter_data(df, x, y, color=color)
    elif kind == "box" and has_y:
        return distribution.box_stats(df, y, x if has_x else None)
    elif kind == "heatmap" and len(numeric_names(df)) > 1:
        return correlation.correlation_matrix(df)
    return None


def _histogram(df: DataFrame, name: str) -> DataFrame:
    if is_numeric(df.schema[name].dataType):
        return distribution.histogram(df, name)
    return groups.value_counts(df, name)

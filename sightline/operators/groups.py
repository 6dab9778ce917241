"""Group-by, value counts, cross tables, hierarchies and KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.parsing import to_number
from sightline.types import col, is_string, num, require

KPI_AGGREGATIONS = ("sum", "mean", "max", "min")


def group_mean(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y by x; the null group is dropped."""
    require(df, x, y)
    return df.filter(col(x).isNotNull()).groupBy(col(x)).agg(F.avg(num(y)).alias("mean_value"))


def group_count(df: DataFrame, x: str) -> DataFrame:
    require(df, x)
    return df.filter(col(x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias("row_count"))


def group_sum(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    require(df, y, *keys)
    return df.dropna(subset=keys).groupBy(*[col(k) for k in keys]).agg(F.sum(num(y)).alias("total"))


def value_counts(df: DataFrame, name: str, top: int | None = None) -> DataFrame:
    """Non-null values by falling count, ties by value; ``top`` keeps the first few."""
    require(df, name)
    counted = (df.filter(col(name).isNotNull()).groupBy(col(name).alias("value"))
               .agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), "value"))
    return counted if top is None else counted.limit(top)


def class_distribution(df: DataFrame, name: str) -> DataFrame:
    """Class, count and percentage of all rows (two decimals)."""
    require(df, name)
    by_value = df.groupBy(col(name).alias("class")).agg(F.count(F.lit(1)).alias("class_count"))
    total = by_value.agg(F.sum("class_count").alias("_n"))  # one row
    return (by_value.join(F.broadcast(total)).filter(F.col("class").isNotNull())
            .select("class", "class_count", F.round(100.0 * F.col("class_count") / F.col("_n"), 2).alias("percentage")))


def crosstab_long(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts of every pair of values that occurs."""
    require(df, x, y)
    return df.dropna(subset=[x, y]).groupBy(col(x), col(y)).agg(F.count(F.lit(1)).alias("row_count"))


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """Contingency table: one row per x, one column per value of y, 0 where a pair does not occur.

    The pivot limit of the session (``spark.sql.pivotMaxValues``) checks the number of columns.
    """
    pairs = crosstab_long(df, x, y).withColumn(y, col(y).cast("string"))
    return pairs.groupBy(col(x)).pivot(y).agg(F.sum("row_count")).na.fill(0)


def _measure(df: DataFrame, value: str) -> Column:
    if value == "count":
        return F.count(F.lit(1)).cast("double")
    require(df, value)
    return F.sum(num(value))


def hierarchy_rollup(df: DataFrame, levels: list[str], value: str = "count") -> DataFrame:
    """Totals for every node of the hierarchy: ``levels..., depth, total``; depth 0 is the root."""
    require(df, *levels)
    if not 1 <= len(levels) <= 3:
        raise ValueError("give one to three levels")
    # the rows are reduced to leaves first, so only leaves are multiplied by the number of levels
    rolled = hierarchy_leaves(df, levels, value).rollup(*[col(c) for c in levels]).agg(
        F.sum("total").alias("_total"), F.grouping_id().alias("_g"))
    depth = F.lit(len(levels)) - F.bit_count("_g")
    return rolled.select(*[col(c) for c in levels], depth.cast("int").alias("depth"), F.col("_total").alias("total"))


def hierarchy_leaves(df: DataFrame, levels: list[str], value: str = "count") -> DataFrame:
    """Leaf totals only."""
    require(df, *levels)
    return df.dropna(subset=levels).groupBy(*[col(c) for c in levels]).agg(_measure(df, value).alias("total"))


def hierarchy_statistics(df: DataFrame, levels: list[str], value: str = "count") -> DataFrame:
    """Number of leaves, their total and average."""
    return hierarchy_leaves(df, levels, value).agg(
        F.count(F.lit(1)).alias("categories"), F.sum("total").alias("total_value"), F.avg("total").alias("average"))


def treemap_data(df: DataFrame, levels: list[str], value: str = "count") -> DataFrame:
    """The same totals for one or two levels."""
    if len(levels) > 2:
        raise ValueError("a treemap has one or two levels")
    return hierarchy_rollup(df, levels, value)


def kpi_column(df: DataFrame, name: str, aggregation: str = "count") -> Column:
    """Aggregate of one KPI; a column without any number falls back to its non-null count."""
    require(df, name)
    filled = F.count(col(name)).cast("double")
    if aggregation not in KPI_AGGREGATIONS:
        return filled
    dtype = df.schema[name].dataType
    number = to_number(col(name)) if is_string(dtype) else num(name)
    by_name = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    return F.coalesce(by_name[aggregation](number), filled)


def kpi(df: DataFrame, name: str, aggregation: str = "count") -> DataFrame:
    value = df.agg(kpi_column(df, name, aggregation).alias("value"))
    return value.select(F.lit(name).alias("column"), F.lit(aggregation).alias("aggregation"), "value",
                        format_kpi(F.col("value")).alias("formatted"))


def format_kpi(value: Column) -> Column:
    """Millions as x.xM, thousands as x.xK, else one decimal."""
    return (F.when(value >= 1e6, F.concat(one_decimal(value / 1e6), F.lit("M")))
            .when(value >= 1e3, F.concat(one_decimal(value / 1e3), F.lit("K")))
            .when(value.isNotNull(), one_decimal(value)))


def one_decimal(value: Column) -> Column:
    """One decimal of the exact binary value, ties to even.

    With the fraction b, 10 b is compared to the midpoint as 8 b - midpoint + 2 b, which is free of rounding.
    """
    size = F.abs(value)
    whole = F.floor(size)
    b = size - whole
    tenth = F.floor(b * 10)
    beyond = (b * 8 - (tenth + 0.5)) + b * 2
    tenth = tenth + F.when((beyond > 0) | ((beyond == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, (whole + F.floor(tenth / 10)).cast("bigint").cast("string"), F.lit("."),
                    (tenth % 10).cast("int").cast("string"))

"""Tests of normality."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.normal import normal_quantile
from sightline.functions.ranks import with_position
from sightline.session import cut_lineage
from sightline.types import col, num, require, small_frame

SHAPIRO_LIMIT = 5000  # values up to which the approximation of the p-value was fitted

# Polynomial coefficients of Royston's approximation (Applied Statistics 44, 1995), low order first.
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
MU_SMALL, SIGMA_SMALL = (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
MU_LARGE, SIGMA_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
GAMMA_SMALL = (-2.273, 0.459)


def ks_normal_test(df: DataFrame, name: str) -> DataFrame:
    """Kolmogorov-Smirnov distance from the normal law with the column's mean and standard deviation."""
    require(df, name)
    x = df.select(num(name).alias("x")).filter("x is not null")
    mean, std, n, low, high = x.agg(F.avg("x"), F.stddev_samp("x"), F.count("x"), F.min("x"), F.max("x")).first()
    schema = "column string, statistic double, p_value double, normal boolean"
    if n < 2 or low == high:
        return small_frame(df.sparkSession, [(name, None, None, None)], schema)
    row = KolmogorovSmirnovTest.test(x, "x", "norm", float(mean), float(std)).first()
    return small_frame(df.sparkSession, [(name, float(row["statistic"]), float(row["pValue"]),
                                          bool(row["pValue"] > 0.05))], schema)


def _poly(coefficients, x: float) -> float:
    return sum(c * x ** i for i, c in enumerate(coefficients))


def _shapiro_weights(n: int) -> np.ndarray:
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total = float(m @ m)
    u = 1.0 / math.sqrt(n)
    a = np.empty(n)
    last = m[-1] / math.sqrt(total) + _poly(WEIGHT_LAST, u)
    if n > 5:
        following = m[-2] / math.sqrt(total) + _poly(WEIGHT_NEXT, u)
        phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * following ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = following, -following
    else:
        phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = last, -last
    return a


def _shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = _poly(GAMMA_SMALL, n)
        if y >= gamma:
            return 1e-19
        z = (-math.log(gamma - y) - _poly(MU_SMALL, n)) / math.exp(_poly(SIGMA_SMALL, n))
    else:
        k = math.log(n)
        z = (y - _poly(MU_LARGE, k)) / math.exp(_poly(SIGMA_LARGE, k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def shapiro_wilk(values: np.ndarray) -> tuple[float | None, float | None]:
    """Statistic and p-value of one sample of 3 or more values."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return None, None
    centred = x - x.mean()
    w = min(1.0, float(_shapiro_weights(n) @ centred) ** 2 / float(centred @ centred))
    return w, _shapiro_p(w, n)


def shapiro_test(df: DataFrame, name: str, by: str | None = None, limit: int = SHAPIRO_LIMIT) -> DataFrame:
    """Shapiro-Wilk per group (or the whole column) of any size: statistic, p-value and a status.

    A value's weight follows from its position in its group, so the statistic is a sum over positions that are found by range
    partitions: no group is gathered, and one that holds a third of the rows is spread over all tasks. The approximation of
    the p-value was fitted up to 5,000 values; larger groups (beyond ``limit``) use it too and have the status
    "approximate p". Groups without variation or of fewer than three values have no statistic.
    """
    require(df, name, *([by] if by else []))
    key = col(by).cast("string") if by else F.lit("all")
    rows = df.select(key.alias("group"), num(name).alias("x")).filter("group is not null and x is not null")
    sizes = cut_lineage(rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.min("x") < F.max("x")).alias("varies")))
    tested = sizes.filter("varies and n > 2").select("group", "n", "mean")
    placed = with_position(rows, ["group"], ["x"], "i").join(tested, "group")
    i, n, m = F.col("i"), F.col("n"), F.col("m")
    weighed = placed.withColumn("p", (i - 0.375) / (n + 0.25)).withColumn("m", normal_quantile("p"))
    weighed = weighed.withColumn("c", F.col("x") - F.col("mean"))
    edge = F.when(n > 5, 2).otherwise(1)  # values on both sides that have weights of their own
    inner = (i > edge) & (i <= n - edge)

    def at(place):
        return F.max(F.when(i == place, F.col("c")))

    sums = weighed.groupBy("group", "n").agg(
        F.sum(m * m).alias("total"), (F.sum(F.col("c") * F.col("c")) - F.sum("c") * F.sum("c") / n).alias("squares"), F.sum(F.when(inner, m * F.col("c")).otherwise(0.0)).alias("inside"),
        (at(n) - at(1)).alias("outer"), (at(n - 1) - at(2)).alias("next"), F.max(F.when(i == n, m)).alias("m1"),
        F.max(F.when(i == n - 1, m)).alias("m2"))
    u = 1 / F.sqrt("n")

    def poly(coefficients):
        return sum((F.lit(c) * F.pow(u, F.lit(k)) for k, c in enumerate(coefficients) if k), F.lit(coefficients[0]))

    last = F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(F.col("m1") / F.sqrt("total") + poly(WEIGHT_LAST))
    second = F.when(n > 5, F.col("m2") / F.sqrt("total") + poly(WEIGHT_NEXT)).otherwise(0.0)
    left = F.col("total") - 2 * F.pow("m1", F.lit(2)) - F.when(n > 5, 2 * F.pow("m2", F.lit(2))).otherwise(0.0)
    phi = left / (1 - 2 * last * last - 2 * second * second)
    middle = F.when(n == 3, 0.0).otherwise(F.col("inside") / F.sqrt(phi))
    w = sums.withColumn("numerator", last * F.col("outer") + second * F.coalesce("next", F.lit(0.0)) + middle)

    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series) -> pd.Series:  # one row per group
        return pd.Series([_shapiro_p(a, b) for a, b in zip(w, n)], dtype="float64")

    found = w.withColumn(
        "statistic", F.least(F.lit(1.0), F.col("numerator") * F.col("numerator") / F.col("squares")))
    found = found.withColumn("p_value", p_value("statistic", "n")).select("group", "statistic", "p_value")
    return sizes.join(found, "group", "left").select(
        "group", n.alias("row_count"), "statistic", "p_value", (F.col("p_value") > 0.05).alias("normal"),
        F.when(F.col("statistic").isNull(), "no variation").when(n > limit, "approximate p").otherwise("tested").alias("status"))

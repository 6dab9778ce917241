"""Pairwise-complete Pearson correlation of many columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.types import chunks, num, sql_num

FUSED_COLUMNS = 9  # up to here pairs are generated aggregates, beyond they are matrix products
WIDE = 200  # columns beyond which the pairs stay a table
TILE = 256  # columns per block of a matrix product
MEANS_PER_JOB = 64
PAIRS_PER_JOB = 14  # more would make one generated method too large for the JIT compiler


def safe_corr(x: Column, y: Column, complete: bool = False) -> Column:
    """Correlation of the rows where both values exist; null where one side does not vary."""
    if not complete:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # a constant may leave a tiny deviation by rounding
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _corr_sql(a: str, b: str, complete: bool) -> str:
    x, y = sql_num(a), sql_num(b)
    if not complete:
        x, y = f"if({y} is not null, {x}, null)", f"if({x} is not null, {y}, null)"
    return (f"if(min({x}) < max({x}) and min({y}) < max({y}), "
            f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y})), null)")


def pair_correlations(df: DataFrame, names: list[str], non_null: dict[str, int], rows: int) -> dict:
    """Correlation for every pair ``names[i], names[j]``, i < j."""
    pairs = list(combinations(names, 2))
    if not pairs:
        return {}
    if len(names) > FUSED_COLUMNS:
        found = pair_table(df, names).collect()  # callers use the table itself beyond WIDE columns
        return {(names[r["i"]], names[r["j"]]): r["correlation"] for r in found}
    full = {n for n in names if non_null.get(n) == rows}
    out = {}
    for group in chunks(pairs, PAIRS_PER_JOB):
        row = df.agg(*[F.expr(_corr_sql(a, b, a in full and b in full)).alias(f"r{i}")
                       for i, (a, b) in enumerate(group)]).first()
        out.update({pair: _clip(row[f"r{i}"]) for i, pair in enumerate(group)})
    return out


def _clip(r):
    return None if r is None else max(-1.0, min(1.0, r))


def pair_table(df: DataFrame, names: list[str], tile: int = TILE) -> DataFrame:
    """``i, j, correlation`` for every pair of columns i < j, as a table: nothing of the size of the pairs is collected.

    Columns are taken in blocks, and every pair of blocks is a scan of its own that reads only their columns: a task holds
    sums for ``tile`` by ``tile`` pairs, whatever the number of columns. Values are shifted by the column mean first so that
    the sums stay well conditioned.
    """
    means: dict[str, float] = {}
    for group in chunks(names, MEANS_PER_JOB):
        row = df.agg(*[F.expr(f"if(min({x}) = max({x}), min({x}), avg({x}))").alias(f"m{i}")
                       for i, x in enumerate(map(sql_num, group))]).first()
        means.update({n: row[f"m{i}"] or 0.0 for i, n in enumerate(group)})
    blocks = chunks(list(range(len(names))), tile)
    sums = None
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            part = _tile_sums(df, names, means, left, right)
            sums = part if sums is None else sums.unionByName(part)
    total = sums.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")], F.min("lx").alias("lx"),
        F.min("ly").alias("ly"), F.max("hx").alias("hx"), F.max("hy").alias("hy"))
    varies = (F.col("lx") < F.col("hx")) & (F.col("ly") < F.col("hy"))  # as for fewer columns
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = F.sqrt(F.greatest(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))) * F.sqrt(
        F.greatest(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"), F.lit(0.0)))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, spread)))
    return total.select("i", "j", F.when(varies & (spread != 0), r).alias("correlation"))


def _tile_sums(df: DataFrame, names: list[str], means: dict[str, float], left: list[int], right: list[int]) -> DataFrame:
    """Partial sums of every pair of a column of ``left`` with a later one of ``right``, one row per task and pair."""
    both = left if left == right else left + right
    shifted = df.select(*[(num(names[c]) - F.lit(means[names[c]])).alias(f"c{c}") for c in both])
    a, b = len(left), len(right)
    rows, cols = np.array(left), np.array(right)
    pick = rows[:, None] < cols[None, :]

    def extremes(x, mask, other):
        """Range of every column over the rows where each column of the other block exists."""
        low = np.repeat(np.where(mask, x, np.inf).min(axis=0)[:, None], other.shape[1], axis=1)
        high = np.repeat(np.where(mask, x, -np.inf).max(axis=0)[:, None], other.shape[1], axis=1)
        for k in np.flatnonzero(~other.all(axis=0)):
            there = mask & other[:, [k]]
            low[:, k], high[:, k] = np.where(there, x, np.inf).min(axis=0), np.where(there, x, -np.inf).max(axis=0)
        return low, high

    def reduce_batches(batches):
        total = lows = highs = None
        for pdf in batches:
            if not len(pdf):
                continue
            data = pdf.to_numpy(dtype="float64")
            x, y = data[:, :a], data[:, -b:]
            mx, my = ~np.isnan(x), ~np.isnan(y)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            fx, fy = mx.astype("float64"), my.astype("float64")
            part = np.stack([fx.T @ fy, x.T @ fy, fx.T @ y, (x * x).T @ fy, fx.T @ (y * y), x.T @ y])
            (lx, hx), (ly, hy) = extremes(x, mx, my), extremes(y, my, mx)
            low, high = np.stack([lx, ly.T]), np.stack([hx, hy.T])
            total, lows, highs = (part, low, high) if total is None else (
                total + part, np.minimum(lows, low), np.maximum(highs, high))
        if total is not None:
            i, j = np.nonzero(pick)
            out = {"i": rows[i], "j": cols[j]}
            out |= {c: total[k][i, j] for k, c in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}
            out |= {"lx": lows[0][i, j], "ly": lows[1][i, j], "hx": highs[0][i, j], "hy": highs[1][i, j]}
            yield pd.DataFrame(out)

    return shifted.mapInPandas(reduce_batches, "i int, j int, n double, sx double, sy double, sxx double, syy double, "
                               "sxy double, lx double, ly double, hx double, hy double")

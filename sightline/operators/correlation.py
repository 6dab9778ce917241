"""Correlation and least-squares tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.correlate import MEANS_PER_JOB, WIDE, pair_correlations, pair_table, safe_corr
from sightline.functions.tablestats import TableStats
from sightline.types import chunks, num, require, small_frame, sql_num


def _pairs(table, names: list[str] | None) -> tuple[TableStats, list[str], dict]:
    s = TableStats.of(table)
    if names is None:
        return s, s.numeric, s.correlations
    require(s.df, *names)
    return s, names, pair_correlations(s.df, names, s.non_null, s.rows)


def _wide(table, names: list[str] | None) -> tuple[TableStats, list[str], bool]:
    s = TableStats.of(table)
    names = s.numeric if names is None else names
    require(s.df, *names)
    return s, names, len(names) > WIDE


def _varies(s: TableStats, names: list[str]) -> dict[str, bool]:
    found = {}
    for group in chunks(names, MEANS_PER_JOB):
        row = s.df.agg(*[F.expr(f"coalesce(min({sql_num(c)}) < max({sql_num(c)}), false)").alias(f"v{i}")
                         for i, c in enumerate(group)]).first()
        found.update({c: row[f"v{i}"] for i, c in enumerate(group)})
    return found


def named_pairs(s: TableStats, names: list[str]) -> DataFrame:
    """The pairs of a wide table with their names: column_1, column_2, correlation."""
    pairs = s.correlation_table if names == s.numeric else pair_table(s.df, names)
    labels = small_frame(s.spark, list(enumerate(names)), "i int, column string")  # one row per column
    first, second = labels.withColumnRenamed("column", "column_1"), labels.toDF("j", "column_2")
    return pairs.join(F.broadcast(first), "i").join(F.broadcast(second), "j").select("column_1", "column_2", "correlation")


def correlation_matrix(table, names: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair, long form; null where a side does not vary.

    Beyond ``WIDE`` columns the pairs are computed and kept as a table."""
    s, wanted, wide = _wide(table, names)
    varies = _varies(s, wanted)
    if wide:
        pairs = named_pairs(s, wanted)
        turned = pairs.select(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"), "correlation")
        own = small_frame(s.spark, [(c, c, 1.0 if varies[c] else None) for c in wanted],
                          "column_1 string, column_2 string, correlation double")
        return pairs.unionByName(turned).unionByName(own)
    s, names, pairs = _pairs(s, names)
    rows = []
    for a in names:
        for b in names:
            r = (1.0 if varies[a] else None) if a == b else pairs.get((a, b), pairs.get((b, a)))
            rows.append((a, b, r))
    return small_frame(s.spark, rows, "column_1 string, column_2 string, correlation double")


def strength(r: float) -> str:
    r = abs(r)
    return "Very Strong" if r > 0.8 else "Strong" if r > 0.6 else "Moderate" if r > 0.4 else "Weak"


def correlation_pairs(table, names: list[str] | None = None, top: int | None = None, sign: str = "any") -> DataFrame:
    """Pairs by falling size of the correlation with a strength label; ``sign`` keeps one side only."""
    s, wanted, wide = _wide(table, names)
    if wide:
        r = F.col("correlation")
        keep = r > 0 if sign == "positive" else r < 0 if sign == "negative" else r.isNotNull()
        label = F.when(F.abs(r) > 0.8, "Very Strong").when(F.abs(r) > 0.6, "Strong").when(F.abs(r) > 0.4, "Moderate").otherwise("Weak")
        found = named_pairs(s, wanted).filter(keep).withColumn("strength", label).orderBy(
            F.abs(r).desc(), "column_1", "column_2")
        return found if top is None else found.limit(top)
    s, _, pairs = _pairs(s, names)
    rows = [(a, b, r, strength(r)) for (a, b), r in pairs.items() if r is not None]
    if sign == "positive":
        rows = [r for r in rows if r[2] > 0]
    elif sign == "negative":
        rows = [r for r in rows if r[2] < 0]
    rows.sort(key=lambda r: (-abs(r[2]), r[0], r[1]))
    return small_frame(s.spark, rows[:top], "column_1 string, column_2 string, correlation double, strength string")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One coefficient."""
    require(df, x, y)
    return df.agg(safe_corr(num(x), num(y)).alias("correlation"))


def target_correlation(table, target: str) -> DataFrame:
    """Size of the correlation of every numeric column with a numeric target, largest first."""
    s = TableStats.of(table)
    require(s.df, target)
    others = [c for c in s.numeric if c != target]
    if target not in s.numeric:
        raise ValueError(f"target {target!r} is not numeric")
    found: dict[str, float] = {}
    if others:
        row = s.df.agg(*[safe_corr(num(c), num(target)).alias(f"r{i}") for i, c in enumerate(others)]).first()
        found = {c: abs(row[f"r{i}"]) for i, c in enumerate(others) if row[f"r{i}"] is not None}
    rows = sorted(found.items(), key=lambda r: (-r[1], r[0]))
    return small_frame(s.spark, rows, "column string, abs_correlation double")


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x: slope, intercept, r squared, rows used."""
    require(df, x, y)
    a, b = num(y), num(x)
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"),
                  F.regr_r2(a, b).alias("r_squared"), F.regr_count(a, b).alias("row_count"))

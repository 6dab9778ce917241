"""The ten data-quality detectors: a detail table each, and one summary of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions import counts
from sightline.functions.correlate import WIDE
from sightline.functions.parsing import strip
from sightline.functions.quantiles import exact_quantiles
from sightline.functions.tablestats import TableStats, share
from sightline.operators.correlation import named_pairs
from sightline.operators.typing import CONVERT_ABOVE
from sightline.types import (AGE_WORDS, MONEY_WORDS, PERCENT_WORDS, col, is_numeric, name_has, num, require,
                             small_frame)

# Issue names in report order.
ISSUES = ("missing_data", "data_type_mismatches", "outliers", "duplicate_rows", "inconsistent_categories",
          "class_imbalance", "skewed_distributions", "low_variance_columns", "multicollinearity", "invalid_values")
EXAMPLES = 5


def detect_missing_data(table) -> DataFrame:
    """Columns with missing cells: count and percentage."""
    s = TableStats.of(table)
    rows = [(c, k, 100.0 * k / s.rows) for c, k in s.nulls.items() if k]
    return small_frame(s.spark, rows, "column string, missing_count bigint, missing_pct double")


def _mismatches(s: TableStats) -> list[tuple]:
    rows = []
    for c in s.strings:
        rates = [share(k, s.rows) or 0.0 for k in s.parse_counts[c]]
        kind = "numeric" if rates[0] > CONVERT_ABOVE else "datetime" if rates[1] > CONVERT_ABOVE else None
        if kind:
            rows.append((c, "string", kind, rates[0], rates[1]))
    return rows


def detect_type_mismatches(table) -> DataFrame:
    """Text columns of which more than 80 % of the rows read as numbers, else as dates; with both rates."""
    s = TableStats.of(table)
    return small_frame(s.spark, _mismatches(s), "column string, current_type string, suggested_type string, "
                       "numeric_rate double, datetime_rate double")


def _outliers(s: TableStats) -> list[tuple]:
    return [(c, k, 100.0 * k / s.numbers[c].n, *s.numbers[c].fences()) for c, k in s.outliers.items() if k]


def detect_outliers_iqr(table, k: float = 1.5) -> DataFrame:
    """Numeric columns with values strictly outside the fences Q1 - k IQR and Q3 + k IQR."""
    s = TableStats.of(table)
    if k == 1.5:
        rows = _outliers(s)
    else:
        from sightline.functions.tablestats import count_outside
        bounds = {c: s.numbers[c].fences(k) for c in s.numeric if s.numbers[c].n}
        rows = [(c, m, 100.0 * m / s.numbers[c].n, *bounds[c]) for c, m in count_outside(s.df, bounds).items() if m]
    return small_frame(s.spark, rows, "column string, outlier_count bigint, outlier_pct double, "
                       "lower_bound double, upper_bound double")


def _fences(df: DataFrame, name: str, k: float) -> tuple[float, float] | None:
    q1, q3 = exact_quantiles(df, [name], (0.25, 0.75))[name]
    return None if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def outlier_rows(df: DataFrame, name: str, k: float = 1.5) -> DataFrame:
    """The rows whose value lies outside the fences."""
    require(df, name)
    bounds = _fences(df, name, k)
    if bounds is None:
        return df.filter(F.lit(False))
    return df.filter((num(name) < F.lit(bounds[0])) | (num(name) > F.lit(bounds[1])))


def outlier_range(df: DataFrame, name: str, k: float = 1.5) -> DataFrame:
    """Number of outliers and their smallest and largest value."""
    return outlier_rows(df, name, k).agg(F.count(num(name)).alias("outlier_count"), F.min(num(name)).alias("lowest"),
                                         F.max(num(name)).alias("highest"))


def zscore_outliers(df: DataFrame, name: str, threshold: float = 3.0) -> DataFrame:
    """Rows with |x - mean| / population standard deviation above the threshold, with the score."""
    require(df, name)
    mean, std, low, high = df.agg(F.avg(num(name)), F.stddev_pop(num(name)), F.min(num(name)), F.max(num(name))).first()
    if not std or low == high:
        return df.withColumn("z_score", F.lit(0.0)).filter(F.lit(False))
    score = F.abs((num(name) - F.lit(mean)) / F.lit(std))
    return df.withColumn("z_score", score).filter(F.col("z_score") > threshold)


def detect_duplicate_rows(table) -> DataFrame:
    """Rows beyond the first of each group of equal rows, and their percentage."""
    s = TableStats.of(table)
    return small_frame(s.spark, [(s.duplicates, share(100.0 * s.duplicates, s.rows))],
                       "duplicate_count bigint, duplicate_pct double")


def duplicate_preview(df: DataFrame, n: int = 10) -> DataFrame:
    """Up to n repeated rows with the number of surplus copies, in order of their values."""
    groups = counts.duplicate_groups(df, "surplus").withColumn("surplus", F.col("surplus") - 1)
    return groups.orderBy(*[col(c).asc_nulls_last() for c in df.columns]).limit(n)


def duplicates_by_column(table) -> DataFrame:
    """Per column: rows beyond the first of each value (null is a value), distinct values, percentage."""
    s = TableStats.of(table)
    rows = []
    for c in s.df.columns:
        unique = s.all_values[c].unique
        repeated = s.rows - unique - (1 if s.nulls[c] else 0)
        rows.append((c, repeated, unique, share(100.0 * repeated, s.rows)))
    return small_frame(s.spark, rows, "column string, duplicate_count bigint, unique_values bigint, "
                       "duplicate_pct double")


def _category_groups(df: DataFrame, names: list[str], base) -> tuple[DataFrame, DataFrame]:
    values = counts.value_counts_long(df, names).withColumn("base_value", base)
    groups = (values.groupBy("column", "base_value").agg(F.count(F.lit(1)).alias("variation_count"))
              .filter("variation_count > 1"))
    return values, groups


def detect_inconsistent_categories(table) -> DataFrame:
    """Spellings that differ only in case or outer blanks: one row per spelling, with the size of its group."""
    s = TableStats.of(table)
    values, groups = _category_groups(s.df, s.strings, F.lower(strip(F.col("value"))))
    return values.join(groups, ["column", "base_value"]).select(
        "column", "base_value", F.col("value").alias("variation"), F.col("cnt").alias("row_count"),
        "variation_count")


def case_variations(df: DataFrame, name: str) -> DataFrame:
    """Values of one column that have a twin differing in case only, with the number of twins."""
    values, groups = _category_groups(df, [name], F.lower("value"))
    return values.join(groups, ["column", "base_value"]).select(
        "value", (F.col("variation_count") - 1).alias("similar_values"), F.lit("Case Variation").alias("issue_type"))


def _imbalance(s: TableStats) -> list[tuple]:
    rows = []
    for c, v in s.values.items():
        if v.unique > 1 and v.top_count / v.rarest > 3:
            rows.append((c, v.top_count / v.rarest, v.top_count, v.rarest, v.unique))
    return rows


def detect_class_imbalance(table) -> DataFrame:
    """Text columns whose largest class is more than three times the smallest."""
    s = TableStats.of(table)
    return small_frame(s.spark, _imbalance(s), "column string, imbalance_ratio double, majority_count bigint, "
                       "minority_count bigint, classes bigint")


def class_balance(df: DataFrame, name: str) -> DataFrame:
    """Classes of one column with their ratio to the smallest class."""
    require(df, name)
    counted = (df.filter(col(name).isNotNull()).groupBy(col(name).alias("class"))
               .agg(F.count(F.lit(1)).alias("class_count")))
    smallest = counted.agg(F.min("class_count").alias("_least"))  # one row
    return counted.join(F.broadcast(smallest)).select(
        "class", "class_count", (F.col("class_count") / F.col("_least")).alias("ratio_to_minority"))


def _skewed(s: TableStats) -> list[tuple]:
    return [(c, st.skew, "Highly Skewed" if abs(st.skew) > 2 else "Moderately Skewed")
            for c, st in s.moments.items() if st.skew is not None and abs(st.skew) > 1]


def detect_skewed(table) -> DataFrame:
    """Numeric columns with population skewness above one in size."""
    s = TableStats.of(table)
    return small_frame(s.spark, _skewed(s), "column string, skewness double, interpretation string")


def skewness_table(table) -> DataFrame:
    """Population skewness of every numeric column with the three-way label."""
    s = TableStats.of(table)
    rows = []
    for c, st in s.moments.items():
        if st.n:
            skew = st.skew if st.skew is not None else 0.0
            label = "Highly Skewed" if abs(skew) > 1 else "Moderately Skewed" if abs(skew) > 0.5 \
                else "Approximately Normal"
            rows.append((c, skew, label))
    return small_frame(s.spark, rows, "column string, skewness double, interpretation string")


def sample_moments(table) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    s = TableStats.of(table)
    return small_frame(s.spark, [(c, st.sample_skew, st.sample_kurt) for c, st in s.moments.items()],
                       "column string, skewness double, kurtosis double")


def _low_variance(s: TableStats) -> list[tuple]:
    rows = []
    others = [c for c in s.df.columns if c not in s.numeric]
    if set(others) - set(s.strings):
        unique = {c: s.all_values[c].unique for c in others}
    else:
        unique = {c: s.values[c].unique for c in others}
    for c in s.df.columns:
        if c in s.numeric:
            var = s.moments[c].var
            if var is not None and var < 0.01:
                rows.append((c, "numeric", var, None))
        else:
            ratio = share(unique[c], s.rows)
            if ratio is not None and ratio < 0.01:
                rows.append((c, "categorical", None, ratio))
    return rows


def detect_low_variance(table) -> DataFrame:
    """Numeric columns with variance below 0.01, other columns with less than 1 % distinct values."""
    s = TableStats.of(table)
    return small_frame(s.spark, _low_variance(s), "column string, kind string, variance double, unique_ratio double")


def low_variance_details(table) -> DataFrame:
    """``detect_low_variance`` with deviation, range, distinct values and most common value."""
    s = TableStats.of(table)
    rows = []
    for c, kind, var, ratio in _low_variance(s):
        if kind == "numeric":
            st = s.moments[c]
            rows.append((c, kind, var, st.std, st.high - st.low, None, None, None))
        else:
            v = s.values[c] if c in s.strings else s.all_values[c]
            rows.append((c, kind, None, None, None, v.unique, ratio, v.top))
    return small_frame(s.spark, rows, "column string, kind string, variance double, std double, value_range double, "
                       "unique_values bigint, unique_ratio double, most_common string")


def _collinear(s: TableStats) -> list[tuple]:
    return [(a, b, r, "Very High" if abs(r) > 0.9 else "High") for (a, b), r in s.correlations.items()
            if r is not None and abs(r) > 0.8]


def _collinear_table(s: TableStats) -> DataFrame:
    """The same for tables of very many columns, as a table."""
    r = F.col("correlation")
    return named_pairs(s, s.numeric).filter(F.abs(r) > 0.8).withColumn(
        "strength", F.when(F.abs(r) > 0.9, "Very High").otherwise("High"))


def detect_multicollinearity(table) -> DataFrame:
    """Pairs of numeric columns correlated above 0.8 in size."""
    s = TableStats.of(table)
    if len(s.numeric) > WIDE:
        return _collinear_table(s)
    return small_frame(s.spark, _collinear(s), "column_1 string, column_2 string, correlation double, strength string")


def validity_rules(df: DataFrame, money: bool = True) -> list[tuple]:
    """Rules that apply by column name to the numeric columns: (column, issue, violation)."""
    rules = []
    for f in df.schema.fields:
        if not is_numeric(f.dataType):
            continue
        x = num(f.name)
        if name_has(f.name, AGE_WORDS):
            rules.append((f.name, "Invalid Age", (x < 0) | (x > 150)))
        if name_has(f.name, PERCENT_WORDS):
            rules.append((f.name, "Invalid Percentage", (x < 0) | (x > 100)))
        if money and name_has(f.name, MONEY_WORDS):
            rules.append((f.name, "Negative Financial Value", x < 0))
    return rules


def violation_counts(df: DataFrame, rules: list[tuple]) -> list[int]:
    if not rules:
        return []
    row = df.agg(*[F.count_if(bad).alias(f"k{i}") for i, (_, _, bad) in enumerate(rules)]).first()
    return list(row)


def detect_invalid_values(table) -> DataFrame:
    """Values impossible for their column name, with the five smallest as examples."""
    s = TableStats.of(table)
    rules = validity_rules(s.df)
    found = [(i, r, k) for i, (r, k) in enumerate(zip(rules, violation_counts(s.df, rules))) if k]
    rows = [(i, c, issue, k) for i, (c, issue, _), k in found]
    frame = small_frame(s.spark, rows, "rule int, column string, issue string, invalid_count bigint")
    if not found:
        return frame.withColumn("examples", F.lit(None).cast("array<double>")).drop("rule")
    cells = F.array(*[F.struct(F.lit(i).alias("rule"), F.when(bad, num(c)).alias("v")) for i, (c, _, bad), _ in found])
    values = s.df.select(F.inline(F.filter(cells, lambda t: t["v"].isNotNull())))
    # the rank filter is applied before the shuffle too: five rows per rule leave each task
    ranked = values.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("v")))
    examples = ranked.filter(F.col("_r") <= EXAMPLES).groupBy("rule").agg(
        F.array_sort(F.collect_list("v")).alias("examples"))
    return frame.join(F.broadcast(examples), "rule").drop("rule")


def _summary_rows(s: TableStats) -> list[tuple]:
    """(issue, count, severity, description) for the ten detectors."""
    out = []
    missing = [100.0 * k / s.rows for k in s.nulls.values() if k]
    worst = max(missing, default=0.0)
    out.append(("missing_data", s.missing_cells, "High" if worst > 50 else "Medium" if worst > 10 else "Low",
                f"{len(missing)} columns have missing values"))
    n = len(_mismatches(s))
    out.append(("data_type_mismatches", n, "High" if n > 5 else "Medium" if n else "Low",
                f"{n} columns may have incorrect data types"))
    rows = _outliers(s)
    n = sum(r[1] for r in rows)
    out.append(("outliers", n, "High" if n > s.rows * 0.1 else "Medium" if n else "Low",
                f"{n} outliers detected across {len(rows)} columns"))
    n = s.duplicates
    pct = share(100.0 * n, s.rows) or 0.0
    out.append(("duplicate_rows", n, "High" if n > s.rows * 0.1 else "Medium" if n else "Low",
                f"{n} duplicate rows found ({pct:.1f}%)"))
    n = 0
    if s.strings:
        n = _category_groups(s.df, s.strings, F.lower(strip(F.col("value"))))[1].count()
    out.append(("inconsistent_categories", n, "Medium" if n else "Low", f"{n} inconsistent categories detected"))
    rows = _imbalance(s)
    n = len(rows)
    out.append(("class_imbalance", n, "High" if any(r[1] > 10 for r in rows) else "Medium" if n else "Low",
                f"{n} columns show class imbalance"))
    n = len(_skewed(s))
    out.append(("skewed_distributions", n, "Medium" if n else "Low", f"{n} columns have skewed distributions"))
    n = len(_low_variance(s))
    out.append(("low_variance_columns", n, "Medium" if n else "Low", f"{n} columns have low variance"))
    if len(s.numeric) < 2:
        out.append(("multicollinearity", 0, "Low", "Not enough numerical columns for multicollinearity analysis"))
    else:
        n = _collinear_table(s).count() if len(s.numeric) > WIDE else len(_collinear(s))
        out.append(("multicollinearity", n, "High" if n else "Low", f"{n} highly correlated pairs detected"))
    rules = validity_rules(s.df)
    n = sum(1 for k in violation_counts(s.df, rules) if k)
    out.append(("invalid_values", n, "High" if n else "Low", f"{n} columns contain invalid values"))
    return out


def issue_summary(table, only_found: bool = False) -> DataFrame:
    """One row per issue: count, severity, description, status."""
    s = TableStats.of(table)
    rows = [(*r, "Needs Attention" if r[1] else "OK") for r in _summary_rows(s) if r[1] or not only_found]
    return small_frame(s.spark, rows, "issue string, issue_count bigint, severity string, description string, "
                       "status string")


DETECTORS = dict(zip(ISSUES, (
    detect_missing_data, detect_type_mismatches, detect_outliers_iqr, detect_duplicate_rows,
    detect_inconsistent_categories, detect_class_imbalance, detect_skewed, detect_low_variance,
    detect_multicollinearity, detect_invalid_values)))


def issue_details(table, issue: str) -> DataFrame:
    """Detail table of one issue."""
    if issue not in DETECTORS:
        raise ValueError(f"unknown issue {issue!r}; one of {ISSUES}")
    return DETECTORS[issue](table)


def detect_all_issues(table) -> dict[str, DataFrame]:
    """Detail tables of all ten issues, from one set of shared statistics."""
    s = TableStats.of(table)
    return {issue: detector(s) for issue, detector in DETECTORS.items()}


# column of each detail table that names the item, and the one that measures it
_ITEMS = {
    "missing_data": ("column", "missing_count"), "data_type_mismatches": ("column", "numeric_rate"),
    "outliers": ("column", "outlier_count"), "duplicate_rows": (None, "duplicate_count"),
    "inconsistent_categories": ("variation", "variation_count"), "class_imbalance": ("column", "imbalance_ratio"),
    "skewed_distributions": ("column", "skewness"), "low_variance_columns": ("column", None),
    "multicollinearity": ("column_1", "correlation"), "invalid_values": ("column", "invalid_count"),
}


def all_issues_table(table) -> DataFrame:
    """Details of all issues in long form: issue, item, measure."""
    out = None
    for issue, details in detect_all_issues(table).items():
        item, measure = _ITEMS[issue]
        part = details.select(
            F.lit(issue).alias("issue"), (col(item) if item else F.lit("table")).alias("item"),
            (col(measure).cast("double") if measure else F.coalesce("variance", "unique_ratio")).alias("measure"))
        out = part if out is None else out.unionByName(part)
    return out


def quality_score(table) -> DataFrame:
    """Completeness, uniqueness, consistency, validity and the weighted overall score (0 to 100)."""
    s = TableStats.of(table)
    if not s.cells:
        return small_frame(s.spark, [(None,) * 5], SCORE_SCHEMA)
    completeness = 100.0 * (s.cells - s.missing_cells) / s.cells
    uniqueness = 100.0 * (s.rows - s.duplicates) / s.rows
    mixed = len(s.mixed_case)
    consistency = 100.0 - 100.0 * mixed / len(s.strings) if s.strings else 100.0
    rules = validity_rules(s.df, money=False)
    broken = sum(1 for k in violation_counts(s.df, rules) if k)
    validity = 100.0 - 100.0 * broken / len(rules) if rules else 100.0
    overall = 0.3 * completeness + 0.3 * uniqueness + 0.2 * consistency + 0.2 * validity
    return small_frame(s.spark, [(completeness, uniqueness, consistency, validity, overall)], SCORE_SCHEMA)


SCORE_SCHEMA = "completeness double, uniqueness double, consistency double, validity double, overall double"

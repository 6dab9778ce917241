"""The cleaning stages, the fixed pipeline over them, and before/after reports.

A stage fits its parameters with aggregates on the current frame and applies them as a lazy projection,
filter or de-duplication; nothing but column-sized parameters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import counts
from sightline.functions.parsing import strip, to_moment, to_number
from sightline.functions.quantiles import exact_quantiles
from sightline.functions.tablestats import TableStats, count_outside, share, value_stats
from sightline.operators.transforms import standardize
from sightline.operators.typing import CONVERT_ABOVE
from sightline.session import cut_lineage
from sightline.types import col, num, small_frame, string_names

Log = list[str]

# Option names in pipeline order, with their defaults.
OPTIONS = {"missing": True, "duplicates": True, "types": False, "outliers": False, "scale": False,
           "categories": False, "low_variance": False}


def impute(table, numeric: str = "median", categorical: str = "mode") -> tuple[DataFrame, Log]:
    """Fill nulls: numbers with median or mean, the rest with the most frequent value or 'Unknown'.

    ``numeric`` may be None to leave numbers alone.
    """
    s = TableStats.of(table)
    holes = [c for c, k in s.nulls.items() if k]
    numbers = [c for c in holes if c in s.numeric]
    others = [c for c in holes if c not in s.numeric] if categorical == "mode" else []
    log: Log = []
    fill: dict[str, Column] = {}
    if numbers and numeric == "median":
        centre = {c: v[0] for c, v in exact_quantiles(s.df, numbers, (0.5,)).items()}
    elif numbers and numeric == "mean":
        row = s.df.agg(*[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        centre = {c: row[f"m{i}"] for i, c in enumerate(numbers)}
    else:
        centre = {}
    for c, v in centre.items():
        if v is not None:
            fill[c] = F.coalesce(num(c), F.lit(float(v)))
            log.append(f"Filled missing values in '{c}' with {numeric}: {v}")
    modes = value_stats(s.df, others)
    for c in others:
        dtype = s.df.schema[c].dataType
        top = modes[c].top
        if top is None and c in s.strings:
            top = "Unknown"
        if top is not None:
            fill[c] = F.coalesce(col(c), F.lit(top).try_cast(dtype))
            log.append(f"Filled missing values in '{c}' with mode: '{top}'")
    return (s.df.withColumns(fill) if fill else s.df), log


def drop_duplicates(table) -> tuple[DataFrame, Log]:
    """One of every group of equal rows; the hashes found once serve the log and the result."""
    df = TableStats.of(table).df
    found = counts.Repeats.of(df)
    removed = counts.duplicate_count(df, found).first()[0] if found.count else 0
    return counts.drop_duplicate_rows(df, found), [f"Removed {removed} duplicate rows"]


def fix_types(table, dates: bool = True) -> tuple[DataFrame, Log]:
    """Text columns become numbers, else dates, when more than 80 % of the rows convert; failures become null."""
    s = TableStats.of(table)
    fixed: dict[str, Column] = {}
    log: Log = []
    for c in s.strings:
        numbers, moments = s.parse_counts[c]
        if s.rows and numbers > CONVERT_ABOVE * s.rows:
            fixed[c] = to_number(col(c))
            log.append(f"Converted '{c}' to numeric type")
        elif dates and s.rows and moments > CONVERT_ABOVE * s.rows:
            fixed[c] = to_moment(col(c))
            log.append(f"Converted '{c}' to datetime type")
    return (s.df.withColumns(fixed) if fixed else s.df), log


def cap_outliers(table, k: float = 1.5, apply: bool = True) -> tuple[DataFrame, Log]:
    """Clip numbers to the fences; columns without outliers keep their type."""
    s = TableStats.of(table)
    quart = exact_quantiles(s.df, s.numeric, (0.25, 0.75))
    bounds = {c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for c, (q1, q3) in quart.items() if q1 is not None}
    found = {c: n for c, n in count_outside(s.df, bounds).items() if n} if apply else {}
    capped = {c: F.when(num(c) < bounds[c][0], F.lit(bounds[c][0])).when(num(c) > bounds[c][1], F.lit(bounds[c][1]))
              .otherwise(num(c)) for c in found}
    return (s.df.withColumns(capped) if capped else s.df), [f"Capped {n} outliers in '{c}'" for c, n in found.items()]


def scale_numbers(table) -> tuple[DataFrame, Log]:
    s = TableStats.of(table)
    if not s.numeric:
        return s.df, []
    return standardize(s.df, s.numeric, ddof=0), [f"Standardized {len(s.numeric)} numeric columns"]


def fix_categories(table) -> tuple[DataFrame, Log]:
    """Lower-case and strip all text columns; the log tells where the number of distinct values fell."""
    df = TableStats.of(table).df
    names = string_names(df)
    tidy = {c: F.lower(strip(col(c))) for c in names}
    if not names:
        return df, []
    counted = counts.value_counts_long(df, names)
    pairs = counted.groupBy("column", F.lower(strip(F.col("value"))).alias("_t")).agg(F.count(F.lit(1)).alias("_d"))
    found = {r["column"]: (r["before"], r["after"]) for r in pairs.groupBy("column").agg(
        F.sum("_d").alias("before"), F.count(F.lit(1)).alias("after")).collect()}  # one row per column
    log = [f"Fixed inconsistent categories in '{c}': {found[c][0]} → {found[c][1]} unique values"
           for c in names if c in found and found[c][0] != found[c][1]]
    return df.withColumns(tidy), log


def drop_low_variance(table) -> tuple[DataFrame, Log]:
    """Drop numbers with variance below 0.01 and other columns with exactly one distinct value."""
    s = TableStats.of(table)
    flat = [c for c in s.numeric if s.moments[c].var is not None and s.moments[c].var < 0.01]
    others = [c for c in s.df.columns if c not in s.numeric]
    if others:  # one distinct value: smallest and largest agree
        row = s.df.agg(*[f(counts.comparable(s.df, c)).alias(f"{k}{i}") for i, c in enumerate(others)
                         for k, f in (("lo", F.min), ("hi", F.max))]).first()
        flat += [c for i, c in enumerate(others) if row[f"lo{i}"] is not None and row[f"lo{i}"] == row[f"hi{i}"]]
    flat = [c for c in s.df.columns if c in flat]
    log = [f"Removed {len(flat)} low variance columns: {flat}"] if flat else []
    return s.df.drop(*flat), log


STAGES = {"missing": impute, "duplicates": drop_duplicates, "types": fix_types, "outliers": cap_outliers,
          "scale": scale_numbers, "categories": fix_categories, "low_variance": drop_low_variance}


def clean(df: DataFrame, options: dict[str, bool] | None = None) -> tuple[DataFrame, Log]:
    """The seven stages in fixed order; by default only the first two are on.

    A stage that shuffled (duplicates) is checkpointed on shared storage if further stages read its rows again.
    """
    chosen = OPTIONS | (options or {})
    unknown = set(chosen) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}; known are {list(OPTIONS)}")
    log: Log = []
    current = df
    for name, stage in STAGES.items():
        if not chosen[name]:
            continue
        s = TableStats(current)
        before = s.missing_cells if name == "missing" else None
        current, lines = stage(s)
        log += lines
        if name == "duplicates" and any(chosen[later] for later in list(STAGES)[list(STAGES).index(name) + 1:]):
            current = cut_lineage(current)
        if before is not None:
            log.append(f"Missing values reduced from {before} to {TableStats(current).missing_cells}")
    return current, log


def log_frame(df: DataFrame, log: Log) -> DataFrame:
    return small_frame(df.sparkSession, list(enumerate(log, 1)), "step int, operation string")


def compare(original, cleaned) -> DataFrame:
    """Rows, columns, missing cells and duplicates before and after, with the reduction."""
    a, b = TableStats.of(original), TableStats.of(cleaned)
    rows = [("rows", a.rows, b.rows), ("columns", len(a.df.columns), len(b.df.columns)),
            ("missing_cells", a.missing_cells, b.missing_cells), ("duplicate_rows", a.duplicates, b.duplicates)]
    return small_frame(a.spark, [(m, x, y, x - y) for m, x, y in rows],
                       "metric string, before bigint, after bigint, reduction bigint")


def compare_types(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Type of every column before and after; 'N/A' where the column does not exist."""
    a = {f.name: f.dataType.simpleString() for f in original.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in cleaned.schema.fields}
    rows = [(c, a.get(c, "N/A"), b.get(c, "N/A"), a.get(c) != b.get(c)) for c in sorted(set(a) | set(b))]
    return small_frame(original.sparkSession, rows, "column string, original_type string, cleaned_type string, "
                       "changed boolean")


def completeness_metrics(original, cleaned) -> DataFrame:
    """Completeness and uniqueness in percent for both tables."""
    a, b = TableStats.of(original), TableStats.of(cleaned)

    def full(s):
        return share(100.0 * (s.cells - s.missing_cells), s.cells)

    def unique(s):
        return share(100.0 * (s.rows - s.duplicates), s.rows)

    return small_frame(a.spark, [("completeness", full(a), full(b)), ("uniqueness", unique(a), unique(b))],
                       "metric string, original_pct double, cleaned_pct double")

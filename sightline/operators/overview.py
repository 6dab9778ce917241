"""Overview, typing summary and descriptive statistics; one row per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.counts import long_numbers
from sightline.functions.tablestats import TableStats, number_stats, share
from sightline.types import col, is_nested, is_numeric, is_string, is_temporal, small_frame

DESCRIBE_SCHEMA = ("column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
                   "q75 double, max double")

# Bytes of one stored value by type.
TYPE_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "bigint": 8, "float": 4, "double": 8,
               "timestamp": 8, "timestamp_ntz": 8}


def overview(table) -> DataFrame:
    """Rows, columns, missing cells and their share, duplicate rows."""
    s = TableStats.of(table)
    pct = share(100.0 * s.missing_cells, s.cells)
    return small_frame(s.spark, [(s.rows, len(s.df.columns), s.missing_cells, pct, s.duplicates)],
                       "row_count bigint, column_count int, missing_cells bigint, missing_pct double, "
                       "duplicate_rows bigint")


def memory_usage(table) -> DataFrame:
    """Estimated bytes per column: type width, or the bytes of the text."""
    s = TableStats.of(table)
    aggs = []
    for i, f in enumerate(s.df.schema.fields):
        c = col(f.name)
        width = TYPE_WIDTHS.get(f.dataType.simpleString())
        if isinstance(f.dataType, T.DecimalType):
            width = 8 if f.dataType.precision <= 18 else 16
        size = F.count(c) * width if width else F.sum(F.octet_length(
            c if is_string(f.dataType) else F.to_json(F.struct(c))).cast("bigint"))
        aggs.append(F.coalesce(size, F.lit(0)).cast("bigint").alias(f"b{i}"))
    row = s.df.agg(*aggs).first()
    return small_frame(s.spark, [(c, row[f"b{i}"]) for i, c in enumerate(s.df.columns)],
                       "column string, bytes bigint")


def kind_of(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if is_string(dtype):
        return "categorical"
    if is_temporal(dtype):
        return "datetime"
    return "boolean" if isinstance(dtype, T.BooleanType) else "other"


def basic_info(table) -> DataFrame:
    """Per column: position, type, kind, missing values; with the row and duplicate counts of the table."""
    s = TableStats.of(table)
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType), s.nulls[f.name], s.rows, s.duplicates)
            for i, f in enumerate(s.df.schema.fields)]
    return small_frame(s.spark, rows, "position int, column string, dtype string, kind string, "
                       "missing_count bigint, row_count bigint, duplicate_rows bigint")


def column_types(table, samples: int = 3) -> DataFrame:
    """Column, type, non-null and null counts, and the smallest distinct values as samples."""
    s = TableStats.of(table)
    rows = [(f.name, f.dataType.simpleString(), s.non_null[f.name], s.nulls[f.name]) for f in s.df.schema.fields]
    frame = small_frame(s.spark, rows, "column string, dtype string, non_null_count bigint, null_count bigint")
    if not samples:
        return frame
    return frame.join(F.broadcast(sample_values(s.df, samples)), "column", "left")


def sample_values(df: DataFrame, k: int) -> DataFrame:
    """The k smallest distinct values of every column as text, found by k aggregates in turn.

    Arrays, structs and maps are compared and shown as JSON text.
    """
    found: dict[str, list] = {c: [] for c in df.columns}
    shown = {f.name: F.to_json(col(f.name)) if is_nested(f.dataType) else col(f.name) for f in df.schema.fields}
    last: dict[str, object] = {}
    for step in range(k):
        active = [c for c in df.columns if step == 0 or c in last]
        if not active:
            break
        smallest = [F.min(shown[c] if step == 0 else F.when(shown[c] > F.lit(last[c]), shown[c])).alias(f"m{i}")
                    for i, c in enumerate(active)]
        row = df.agg(*smallest).first()
        last = {c: row[f"m{i}"] for i, c in enumerate(active) if row[f"m{i}"] is not None}
        for c, v in last.items():
            found[c].append(str(v))
    return small_frame(df.sparkSession, [(c, ", ".join(v)) for c, v in found.items()],
                       "column string, sample_values string")


def dtype_distribution(table) -> DataFrame:
    """Number of columns by type."""
    s = TableStats.of(table)
    rows = [(f.dataType.simpleString(),) for f in s.df.schema.fields]
    return (small_frame(s.spark, rows, "dtype string").groupBy("dtype")
            .agg(F.count(F.lit(1)).alias("column_count")).orderBy(F.desc("column_count"), "dtype"))


def missing_summary(table) -> DataFrame:
    """Columns with missing values: count and percentage (two decimals), most missing first."""
    s = TableStats.of(table)
    rows = sorted(((c, k, round(100.0 * k / s.rows, 2)) for c, k in s.nulls.items() if k), key=lambda r: (-r[1], r[0]))
    return small_frame(s.spark, rows, "column string, missing_count bigint, missing_pct double")


def nullity_correlation(table) -> DataFrame:
    """Correlation between the is-missing indicators of the columns that are neither full nor empty."""
    from sightline.functions.correlate import pair_correlations
    s = TableStats.of(table)
    mixed = [c for c in s.df.columns if 0 < s.nulls[c] < s.rows]
    flags = s.df.select(*[col(c).isNull().cast("double").alias(c) for c in mixed])
    found = pair_correlations(flags, mixed, {c: s.rows for c in mixed}, s.rows)
    return small_frame(s.spark, [(a, b, r) for (a, b), r in found.items()],
                       "column_1 string, column_2 string, correlation double")


def nullity_patterns(df: DataFrame) -> DataFrame:
    """Rows by pattern of missing cells, '1' where the cell is missing, in column order."""
    bits = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("row_count"))


def missing_pattern_by_row(df: DataFrame) -> DataFrame:
    """Rows by number of missing cells."""
    cells = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.groupBy(cells.alias("missing_cells")).agg(F.count(F.lit(1)).alias("row_count"))


def describe_row(name: str, st) -> tuple:
    return name, st.n, st.mean, st.std, st.low, st.q1, st.median, st.q3, st.high


def describe_numeric(table, names: list[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation (n-1), range and linear quartiles."""
    s = TableStats.of(table)
    stats = s.numbers if names is None else number_stats(s.df, names)
    return small_frame(s.spark, [describe_row(c, stats[c]) for c in (names or s.numeric)], DESCRIBE_SCHEMA)


def shape_labels(skew, kurt) -> tuple[str | None, str | None]:
    if skew is None:
        skew_label = None
    elif abs(skew) < 0.5:
        skew_label = "Approximately symmetric"
    else:
        skew_label = "Right-skewed" if skew > 0.5 else "Left-skewed"
    if kurt is None:
        kurt_label = None
    elif abs(kurt) < 0.5:
        kurt_label = "Normal kurtosis"
    else:
        kurt_label = "Heavy-tailed" if kurt > 0.5 else "Light-tailed"
    return skew_label, kurt_label


def numeric_modes(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Most frequent number per column, ties to the smallest."""
    out: dict[str, float | None] = {n: None for n in names}
    if names:
        counted = long_numbers(df, names).groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))
        best = counted.groupBy("column").agg(F.min(F.struct((-F.col("k")).alias("k"), "v"))["v"].alias("v"))
        out.update({r["column"]: r["v"] for r in best.collect()})  # one row per column
    return out


def describe_extended(table, names: list[str] | None = None) -> DataFrame:
    """``describe_numeric`` plus mode, corrected skewness and kurtosis, range, IQR and shape labels."""
    s = TableStats.of(table)
    names = names or s.numeric
    stats = s.numbers if set(names) == set(s.numeric) else number_stats(s.df, names)
    modes = numeric_modes(s.df, names)
    rows = []
    for c in names:
        st = stats[c]
        skew, kurt = st.sample_skew, st.sample_kurt
        spread = None if st.n == 0 else st.high - st.low
        rows.append(describe_row(c, st) + (modes[c], skew, kurt, spread, st.iqr) + shape_labels(skew, kurt))
    return small_frame(s.spark, rows, DESCRIBE_SCHEMA + ", mode double, skewness double, kurtosis double, "
                       "value_range double, iqr double, skew_label string, kurtosis_label string")


def describe_categorical(table) -> DataFrame:
    """Per text column: distinct values, most frequent value (ties to the smallest) and its count."""
    s = TableStats.of(table)
    rows = [(c, v.non_null, v.unique, v.top, v.top_count) for c, v in s.values.items()]
    return small_frame(s.spark, rows, "column string, count bigint, unique_values bigint, most_frequent string, "
                       "frequency bigint")


def describe_all(table) -> DataFrame:
    """Numeric and text statistics in one table; cells that do not apply are null."""
    s = TableStats.of(table)
    text = describe_categorical(s).select(
        "column", "count", F.col("unique_values").alias("unique"), F.col("most_frequent").alias("top"),
        F.col("frequency").alias("freq"))
    return describe_numeric(s).unionByName(text, allowMissingColumns=True)


def column_quality_table(table) -> DataFrame:
    """Per column: type, missing percentage, distinct values, most frequent value."""
    s = TableStats.of(table)
    rows = [(f.name, f.dataType.simpleString(), share(100.0 * s.nulls[f.name], s.rows), s.all_values[f.name].unique,
             s.all_values[f.name].top) for f in s.df.schema.fields]
    return small_frame(s.spark, rows, "column string, dtype string, missing_pct double, unique_values bigint, "
                       "most_frequent string")


def summarize(table) -> dict[str, DataFrame]:
    """The four parts of the summary, from one set of shared statistics."""
    s = TableStats.of(table)
    return {"basic_info": overview(s), "numeric_summary": describe_numeric(s),
            "categorical_summary": describe_categorical(s), "data_types": dtype_distribution(s)}


def summary_table(table) -> DataFrame:
    """The numbers of ``summarize`` in long form: section, item, measure, value."""
    s = TableStats.of(table)
    parts = summarize(s)
    info = _long(parts["basic_info"].withColumn("item", F.lit("table")), "basic_info",
                 ["row_count", "column_count", "missing_cells", "duplicate_rows"])
    numbers = _long(parts["numeric_summary"].withColumnRenamed("column", "item"), "numeric_summary",
                    ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])
    texts = _long(parts["categorical_summary"].withColumnRenamed("column", "item"), "categorical_summary",
                  ["unique_values", "frequency"])
    return info.unionByName(numbers).unionByName(texts)


def _long(df: DataFrame, section: str, measures: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), col(m).cast("double").alias("value")) for m in measures])
    return df.select(F.lit(section).alias("section"), "item", F.inline(cells))


def data_overview(table) -> dict[str, DataFrame]:
    """Tables behind the overview board: types, missing counts, numeric and first five text columns."""
    s = TableStats.of(table)
    first = s.strings[:5]
    return {"data_types": dtype_distribution(s), "missing": missing_summary(s), "numeric": describe_numeric(s),
            "categorical": describe_categorical(s).filter(F.col("column").isin(first))}

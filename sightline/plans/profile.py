"""The full profile of a table from one set of shared statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.tablestats import TableStats
from sightline.operators import filters, overview, quality, typing
from sightline.sources.export import document
from sightline.types import col


def profile(table) -> dict[str, DataFrame]:
    """Column information, type suggestions, quality scores, and the parts of the summary."""
    s = TableStats.of(table)
    return {"basic_info": overview.basic_info(s), "type_suggestions": typing.suggest_types(s),
            "quality_scores": quality.quality_score(s),
            "summary_statistics": overview.summary_table(s), "data_types": overview.dtype_distribution(s)}


def dataset_context(table, rows: int = 3) -> DataFrame:
    """One JSON document describing the table: types, missing values, statistics, first rows."""
    s = TableStats.of(table)
    sample = filters.preview(s.df, rows).select(*[col(c).cast("string").alias(c) for c in s.df.columns])
    info = overview.basic_info(s).select("position", "column", "dtype", "kind", "missing_count", F.lit(s.rows).alias(
        "row_count"))
    return document({"columns": info, "summary_stats": overview.describe_numeric(s), "sample_data": sample})

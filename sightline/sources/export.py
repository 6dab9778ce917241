"""Sinks: CSV, and JSON reports built from the summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.tablestats import TableStats
from sightline.operators import cleaning, overview
from sightline.types import col, is_nested


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV holds plain values only."""
    return df.select(*[F.to_json(col(f.name)).alias(f.name) if is_nested(f.dataType) else col(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, one file per partition; text is quoted and kept as it is, blanks and newlines included."""
    flat(df).write.mode(mode).csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                                  ignoreTrailingWhiteSpace=False)


def _rows(df: DataFrame):
    """A column-sized table as one array of structs."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*[col(c) for c in df.columns]))).alias("rows"))


def document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON text, with every (column-sized) table under its name."""
    out = None
    for name, part in parts.items():
        one = _rows(part).withColumnRenamed("rows", name)
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct(*[col(c) for c in out.columns])).alias("document"))


def export_summary(table) -> DataFrame:
    """Overview, missing, numeric and text summaries as one JSON document."""
    s = TableStats.of(table)
    return document({"overview": overview.overview(s), "missing": overview.missing_summary(s),
                     "numeric": overview.describe_numeric(s), "categorical": overview.describe_categorical(s)})


def export_statistics(table, path: str | None = None) -> DataFrame:
    """The joint description of all columns; written as CSV when a path is given."""
    frame = overview.describe_all(table)
    if path is not None:
        write_csv(frame, path, "overwrite")
    return frame


def cleaning_report(original: DataFrame, cleaned: DataFrame, log: list[str]) -> DataFrame:
    """Shapes, operations and quality metrics of a cleaning run as one JSON document."""
    a, b = TableStats.of(original), TableStats.of(cleaned)
    return document({"shape": cleaning.compare(a, b), "operations": cleaning.log_frame(a.df, log),
                     "metrics": cleaning.completeness_metrics(a, b)})


def write_report_json(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.write.mode(mode).text(path)

"""Interpreter of a dashboard specification given as a dict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.charts import chart_data
from sightline.operators.groups import format_kpi, kpi_column


def kpi_table(df: DataFrame, kpis: list[dict]) -> DataFrame | None:
    """All KPIs of the specification from one fused aggregate; unknown columns are skipped."""
    usable = [k for k in kpis if k.get("column") in df.columns]
    if not usable:
        return None
    row = df.agg(*[kpi_column(df, k["column"], k.get("aggregation", "count")).alias(f"k{i}")
                   for i, k in enumerate(usable)])
    cells = F.array(*[F.struct(F.lit(k.get("name", k["column"])).alias("name"), F.lit(k["column"]).alias("column"),
                               F.lit(k.get("aggregation", "count")).alias("aggregation"),
                               F.col(f"k{i}").alias("value"), format_kpi(F.col(f"k{i}")).alias("formatted"))
                      for i, k in enumerate(usable)])
    return row.select(F.inline(cells))


def run_dashboard(df: DataFrame, spec: dict) -> dict[str, DataFrame]:
    """``{"kpis": table, "<chart title>": table, ...}``; charts that cannot be made are left out."""
    out: dict[str, DataFrame] = {}
    kpis = kpi_table(df, spec.get("kpis") or [])
    if kpis is not None:
        out["kpis"] = kpis
    for i, chart in enumerate(spec.get("charts") or []):
        data = chart_data(df, chart)
        if data is not None:
            title = chart.get("title", "Chart")
            out[title if title not in out else f"{title} ({i})"] = data
    return out

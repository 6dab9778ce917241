"""Interpreter of a cleaning plan given as a dict."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sightline.functions.tablestats import TableStats
from sightline.operators import cleaning


def apply_cleaning_plan(df: DataFrame, plan: dict) -> tuple[DataFrame, list[str]]:
    """Items of ``priority_issues`` in order; words in the issue choose the stage, words in the strategy its way."""
    log: list[str] = []
    current = df
    for item in plan.get("priority_issues", []):
        issue, strategy = item["issue"].lower(), item["strategy"].lower()
        s = TableStats(current)
        if "missing" in issue:
            way = "median" if "median" in strategy else "mean" if "mean" in strategy else None
            current, lines = cleaning.impute(s, numeric=way)
        elif "duplicate" in issue:
            current, lines = cleaning.drop_duplicates(s)
        elif "outlier" in issue:
            current, lines = cleaning.cap_outliers(s, apply="cap" in strategy or "clip" in strategy)
        elif "type" in issue:
            current, lines = cleaning.fix_types(s, dates=False)
        else:
            lines = []
        log += lines
    return current, log

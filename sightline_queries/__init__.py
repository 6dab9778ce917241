"""Queries over the given tables with the SQL that checks them."""

from sightline_queries.registry import ORACLE, QUERIES
from sightline_queries import advice_queries, chart_queries, clean_queries, model_queries, profile_queries, \
    quality_queries  # noqa: F401  (each module registers its queries)

__all__ = ["ORACLE", "QUERIES"]

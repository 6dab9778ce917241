"""Every registered query with SQL must equal DuckDB; the others must return rows."""

import pytest

from sightline_queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    # the last rounded digit may differ between the engines
    ok, message, _ = compare(spark, duck, QUERIES[name], ORACLE[name], SF_DIR, tolerance=2e-6)
    assert ok, message


@pytest.mark.parametrize("name", ["compare_algorithms", "feature_engineering", "preprocessing_steps", "profile",
                                  "dataset_context", "export_summary", "ml_recommendations", "tips_and_challenges"])
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)

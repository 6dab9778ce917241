"""Registered queries equal their SQL in DuckDB, and give one row per row of their table."""

import pytest

from sightline.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    ok, message, _ = compare(spark, connect(SF_DIR), QUERIES[name], ORACLE[name], SF_DIR)
    assert ok, message


@pytest.mark.parametrize("name,table", [("op2_sentencepiece", "documents"), ("op3_quality", "documents"),
                                        ("op5_privacy", "documents"), ("op7_licenses", "documents"), ("op8_html", "pages"),
                                        ("op10_simhash", "documents")])
def test_whole_table(spark, name, table):
    assert QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))

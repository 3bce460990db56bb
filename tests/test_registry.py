"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from noteloom.checks import registry
from noteloom.checks.compare import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], SQL.get(name)) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0


def test_shards_lose_nothing(spark, sf):
    assert QUERIES["vector_shards_roundtrip"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()

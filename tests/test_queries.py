import pytest
from oracle import agree, connect

from lodestone import queries, queries_engine

QUERIES = queries.QUERIES | queries_engine.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | queries_engine.ORACLE_SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    agree(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


def test_protected_token_lists_more_hits_than_any_page(spark, tmp_path):
    """100 050 documents hold the word; no page size cuts them."""
    docs = spark.range(100_050).selectExpr("id AS doc_id", "repeat('than ', CAST(1 + id % 3 AS INT)) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    agree(queries_engine.q5_protected_token(spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL["q5_protected_token"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

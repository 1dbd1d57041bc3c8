import pytest
from oracle import agree, connect

from lodestone.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, con, name):
    agree(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])

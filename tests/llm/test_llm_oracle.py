import pytest
from oracle import same

from sitelake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name]) > 0

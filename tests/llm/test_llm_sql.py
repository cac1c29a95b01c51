import oracle
import pytest

from quarry.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF), SQL[name], oracle.connect(SF)) == ""

import pytest

from isohypse.llm import queries
from tests.compare import differences


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(name, spark):
    assert differences(queries.QUERIES[name], queries.ORACLES[name], spark, "/root/testdata/sf0.01") == ""

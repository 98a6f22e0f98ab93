import pytest
from oracle import same

from gridloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(name, spark, data, duck):
    same(queries.QUERIES[name](spark, data), queries.ORACLES[name], duck)

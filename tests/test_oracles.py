"""Every query outside the llm subpackage that has an oracle gives its rows on the smallest tables."""

import pytest
from oracle import same

from gridloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(name, spark, data, duck):
    same(catalog.QUERIES[name](spark, data), catalog.ORACLES[name], duck)

import pytest

from tessera.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(agree, name):
    agree(QUERIES[name], ORACLES[name])

import os

import pytest

from folioscan.llm.oracle import oracle_sql
from folioscan.llm.queries import queries
from tests.conftest import DATA, compare


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    directory = f"{DATA}/sf0.001"
    got, expected = compare(queries()[name](spark, directory), oracle_sql()[name], directory)
    assert got == expected

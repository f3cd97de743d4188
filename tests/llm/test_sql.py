"""The numbered queries that SQL can express, against their SQL on the driver's tables."""

import os

import pytest

from reelspark.llm import queries
from tests.compare import differences

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == []

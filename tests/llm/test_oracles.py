"""Every query of this subpackage that has SQL against DuckDB, on the smallest tables."""

import os

import pytest

from sketchloom.llm import queries
from tests.test_oracles import SF, agree, tables  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, tables, name):  # noqa: F811
    agree(queries.QUERIES[name](spark, SF).toPandas(), tables.execute(queries.ORACLES[name]).df())

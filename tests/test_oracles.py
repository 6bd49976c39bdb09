"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sketchloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def agree(found, expected):
    """Equal columns and rows in any order; floating numbers as numbers, whatever their sign of zero and their nulls' type."""
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) == len(expected) and (len(found) > 0 or len(expected) == 0)
    numbers = [c for c in found.columns if found[c].dtype.kind == "f" or expected[c].dtype.kind == "f"]
    others = sorted(set(found.columns) - set(numbers))
    sides = []
    for frame in (found, expected):
        own = frame[others].astype(str).assign(**{c: frame[c].astype(float) for c in numbers})
        sides.append(own.sort_values([*others, *numbers]).reset_index(drop=True))
    assert sides[0][others].equals(sides[1][others])
    for c in numbers:
        assert sides[0][c].to_numpy() == pytest.approx(sides[1][c].to_numpy(), abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tables, name):
    agree(catalogue.QUERIES[name](spark, SF).toPandas(), tables.execute(catalogue.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

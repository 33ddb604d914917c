"""Every registered query that has SQL gives the same rows at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    same, report = compare(spark, duck, SF, name, entry.queries()[name], SQL[name])
    assert same, report


def test_the_flagship_query_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["bucket", "rows", "share", "positive_rate"] and out.count() > 0


def test_every_operator_is_registered():
    named = set(entry.queries())
    expected = {
        "src": (1, 2, 4, 5, 6, 7, 8, 9, 10),
        "flt": range(1, 11),
        "join": range(1, 13),
        "agg": range(1, 19),
        "win": range(1, 15),
        "top": (1, 2, 3, 5),
        "set": (1, 2),
        "scl": (1, 2, 3, 4, 5, 6, 7, 9, 10),
        "fwi": range(1, 7),
        "ml": range(1, 16),
        "ev": range(1, 6),
        "bt": range(1, 6),
        "cal": range(1, 9),
        "xai": range(1, 5),
        "srv": range(1, 5),
        "pipe": (1, 2),
        "str": range(1, 6),
    }
    wanted = {f"{group}_{n}" for group, numbers in expected.items() for n in numbers}
    assert len(wanted) == 132 and wanted <= named

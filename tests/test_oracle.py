"""Every registered query against its SQL twin on the smallest tables."""

import pathlib

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from postlake.plans.oracle import ORACLES
from postlake.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, tables, name):
    found = entry.queries()[name](spark, FOLDER)
    assert differences(found, tables, entry.oracle_sql()[name]) is None


def test_no_twin_is_empty():
    """Two empty results would agree on anything."""
    folder = pathlib.Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = connect(str(folder))
    assert [n for n, sql in ORACLES.items() if not con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]] == []

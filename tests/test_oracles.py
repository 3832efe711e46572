"""Every registered query runs, and equals its SQL on the smallest given tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from motorlake.catalog.registry import QUERIES
from check import compare, duck

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert df.count() > 0
        return
    ok, why, _ = compare(df, con, oracle)
    assert ok, why


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

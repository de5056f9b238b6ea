"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from compare import check, oracle
from granary.plans.registry import REGISTRY, Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, connection, name):
    verdict, _, _ = check(spark, FOLDER, connection, REGISTRY[name], Tables(spark, FOLDER))
    assert verdict == "ok" or verdict.startswith("rows-only"), verdict


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) > 12 and rows[0]["bucket"] < rows[-1]["bucket"]


def test_contract():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

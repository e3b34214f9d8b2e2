import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from leadrank.plans import catalog
from tests.conftest import TEST_DATA
from tests.oracle import compare, connect

FOLDER = f"{TEST_DATA}/sf0.001"
SLOW = {"two_runs", "arriving_runs", "stored_evidence"}  # their plans run in test_daily


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_equals_its_sql(spark, connection, name):
    problem, rows, _ = compare(spark, connection, FOLDER, name)
    assert problem is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(contract.queries())


def test_no_machine_bound_calls():
    files = [path for path in Path(__file__).parent.parent.glob("leadrank/**/*.py") if "llm" not in path.parts]
    source = "\n".join(path.read_text() for path in files)
    assert not re.search(r"localCheckpoint|crossJoin|\.toPandas\(|\.rdd\b(?!\.getNumPartitions)", source)

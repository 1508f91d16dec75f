"""Every registered query against its SQL, on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from workload.compare import differences
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert differences(spark, SF_DIR, name) == []


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"price_category", "num_listings"}

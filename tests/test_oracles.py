"""Every registered query against its SQL twin on the smallest folder."""

import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry
from folioscope.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    status, _, _ = compare(spark, con, FOLDER, name)
    assert status == "ok"


def test_every_query_has_a_twin():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_entry_runs(spark):
    assert entry(spark).count() > 0

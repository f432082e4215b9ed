"""Queries with a SQL twin against it; the entry's contract for the others."""

import pytest
from check_oracles import compare, connect

from folioscope.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name)[0] == "ok"


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

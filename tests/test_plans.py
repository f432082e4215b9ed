"""Physical plans with broadcasting off: what a query does when nothing is small."""

import contextlib
import io

import pytest

from folioscope.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return {name: plan(run(spark, FOLDER)) for name, run in catalog.QUERIES.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_nested_loops(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_no_rows_are_ordered_in_one_task(plans):
    """A window in one task sees sums of buckets (``_n``) at most."""
    for name, text in plans.items():
        parts = text.split("Arguments: SinglePartition")
        for after in parts[1:]:
            near = "\n\n".join(after.split("\n\n")[1:3])
            assert "Window" not in near or "_n#" in near, name


def test_only_bounded_frames_are_broadcast(plans):
    found = {name for name, text in plans.items() if "BroadcastExchange" in text}
    axis_patterns = {name for name in found if "p_treatment" in plans[name]}
    assert found == axis_patterns


def test_scans_are_pruned(plans):
    assert "ReadSchema: struct<l_returnflag:string,l_partkey" not in plans["percent_scale"]
    schema = [line for line in plans["union_accounting"].splitlines() if line.startswith("ReadSchema")]
    assert schema == ["ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>"]
    pushed = [line for line in plans["complement"].splitlines() if line.startswith("PushedFilters")]
    assert any("o_orderdate" in line for line in pushed)


def test_page_assembly_moves_words_once(plans):
    words = [b for b in plans["measured_pages"].split("\n\n") if "Exchange" in b and "word_no" in b]
    assert len(words) <= 1


def test_flagship_moves_no_text(plans):
    moved = [b for b in plans["words_by_chunk"].split("\n\n") if ") Exchange" in b and "text#" in b]
    assert not moved

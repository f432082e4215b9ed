import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators.checks import check_rows, verdict
from folioscope.session import cut_lineage
from folioscope.sources import entities, readers, writers


def test_documents_and_rejects(spark, tmp_path):
    for name, text in {"a.json": '{"x": {"y": [1, null]}}', "b.json": "[1]", "c.json": "{oops"}.items():
        (tmp_path / name).write_text(text)
    good, bad = readers.read_documents(spark, str(tmp_path / "*.json"))
    assert [r.j for r in good.select(F.to_json("doc").alias("j")).collect()] == ['{"x":{"y":[1,null]}}']
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()} == {("b.json", "not a JSON object"), ("c.json", "not valid JSON")}


def test_ledger_keeps_missing_and_null_apart(spark, tmp_path):
    line = {"id": "E1", "before_file": "f", "before_record_sha256": "b", "proposed_record_sha256": "p", "field_diffs": [
        {"path": "/a", "operation": "add", "after": [1]}, {"path": "/b", "operation": "replace", "before": None, "after": "é"}]}
    path = tmp_path / "l.jsonl"
    path.write_text(json.dumps(line, ensure_ascii=False) + "\n")
    got = readers.ledger_changes(readers.read_ledger(spark, str(path))).orderBy("pointer").collect()
    assert [(r.pointer, r.op, r.before, r.after) for r in got] == [("/a", "add", None, "[1]"), ("/b", "replace", "null", '"é"')]
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.read_ledger(spark, str(path)).collect()


def test_file_digests(spark, tmp_path):
    data = bytes(range(256)) * 50
    (tmp_path / "x.bin").write_bytes(data)
    r = readers.read_files(spark, str(tmp_path / "*.bin")).first()
    assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())


XML = """<html xmlns="http://www.w3.org/1999/xhtml"><body><doc>
<page width="1" height="1"><flow><block><line yMin="10.5" yMax="20"><word yMin="10.5" yMax="20.5">One</word><word yMin="12" yMax="18">2</word></line></block>
<block><line yMin="30" yMax="40"><word yMin="30" yMax="40">after</word></line></block></flow></page>
<page width="1" height="1"></page>
<page width="1" height="1"><flow><block><line yMin="5" yMax="9"><word yMin="5" yMax="9">third</word></line></block></flow></page>
</doc></body></html>"""


def test_layout_from_xml(spark, tmp_path, rows):
    (tmp_path / "book.xml").write_text(XML)
    words = readers.read_layout(spark, str(tmp_path / "book.xml"))
    assert rows(words.select("source_id", "page", "line_no", "word_no", "text", "y_min", "line_y_min")) == [
        ("book", 1, 0, 0, "One", 10.5, 10.5), ("book", 1, 0, 1, "2", 12.0, 10.5), ("book", 1, 1, 0, "after", 30.0, 30.0),
        ("book", 3, 0, 0, "third", 5.0, 5.0),
    ]


def test_entities_keep_parent_and_position(spark, rows):
    doc = {
        "subjects": [{"subject_id": "S1", "evidence": [{"evidence_id": "E1"}, {"evidence_id": "E2"}], "required_access_facets": [{"facet_id": "F1"}]},
                     {"subject_id": "S2", "evidence": [{"evidence_id": "E1"}]}],
        "relationships": [{"relationship_id": "R1"}],
        "reader_tasks": [{"task_id": "T1", "required_access_facets": [{"facet_id": "F1"}]}],
    }
    docs = spark.createDataFrame([("v1", json.dumps(doc))], "version string, json string").select("version", F.parse_json("json").alias("doc"))
    tables = entities.explode_entities(docs)
    assert rows(tables["subjects.evidence"].select("parent_id", "id", "pos")) == [("S1", "E1", 0), ("S1", "E2", 1), ("S2", "E1", 0)]
    assert rows(tables["reader_tasks.required_access_facets"].select("parent_id", "id")) == [("T1", "F1")]
    assert tables["subjects"].count() == 2 and tables["exclusions"].count() == 0


def test_snapshots_and_checks(spark, tmp_path):
    df = spark.range(5)
    writers.write_snapshot(df, str(tmp_path / "s"), 1)
    writers.write_snapshot(df.filter("id > 2"), str(tmp_path / "s"), 2)
    writers.write_snapshot(df.filter("id > 3"), str(tmp_path / "s"), 2)
    assert writers.read_snapshot(spark, str(tmp_path / "s"), 1).count() == 5
    assert writers.read_snapshot(spark, str(tmp_path / "s"), 2).count() == 1
    checks = check_rows(df, "small", F.col("id"), F.when(F.col("id") != 4, F.lit(True)), F.lit("d"))
    writers.write_checks(checks, str(tmp_path / "c"))
    writers.write_checks(checks.filter("ok"), str(tmp_path / "c"))
    r = verdict(spark.read.parquet(str(tmp_path / "c"))).first()
    assert (r.n_checks, r.n_failed, r.ok) == (9, 1, False)


def test_lineage_cut_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert cut_lineage(df).agg(F.sum("x")).first()[0] == 90

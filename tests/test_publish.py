import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.canonical import canonical_json, drop_fields
from folioscope.operators.checks import check_rows
from folioscope.sources import publish, readers


def passing(rows):
    return check_rows(rows, "not_null", F.col("id"), F.col("id").isNotNull(), F.lit(""))


def test_a_stage_is_seen_after_its_checks_pass(spark, tmp_path):
    path = str(tmp_path / "d")
    with pytest.raises(ValueError):
        publish.read_stage(spark, path, 0)
    with pytest.raises(ValueError):
        publish.publish(spark.range(3), path, 1, passing)
    assert publish.publish(spark.range(3), path, 0, passing)
    bad = spark.createDataFrame([(1,), (None,)], "id bigint")
    assert not publish.publish(bad, path, 0, passing)
    assert not publish.publish(spark.range(9), path, 0, lambda rows: passing(rows).filter("false"))
    assert publish.read_stage(spark, path, 0).count() == 3
    with pytest.raises(ValueError):
        publish.read_stage(spark, path, 1)
    assert publish.publish(spark.range(5), path, 0, passing) and publish.read_stage(spark, path, 0).count() == 5
    assert publish.publish(spark.range(4), path, 1, passing) and publish.read_stage(spark, path, 1).count() == 4
    log = publish.read_log(spark, path).filter("stage = 0").orderBy("seq").collect()
    assert [(r.seq, r.ok, r.n_failed) for r in log] == [(1, True, 0), (2, False, 1), (3, False, 0), (4, True, 0)]
    assert publish.stage_checks(spark, path, log[1].run).filter("not ok").count() == 1


def test_a_killed_writer_leaves_the_old_stage(spark, tmp_path):
    path = str(tmp_path / "d")
    publish.publish(spark.range(3), path, 0, passing)
    for broken in (lambda rows: rows.select(F.raise_error(F.lit("killed"))), lambda rows: 1 / 0):
        with pytest.raises(Exception):
            publish.publish(spark.range(7), path, 0, broken)
    half = spark.range(8).withColumn("id", F.when(F.col("id") < 6, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("bigint")))
    with pytest.raises(Exception):
        publish.publish(half, path, 0, passing)
    assert publish.read_stage(spark, path, 0).count() == 3


def test_canonical_json_is_python_s(spark):
    texts = [
        '{"a":1e-7,"b":1.5e16,"c":1.50,"d":-0,"e":-0.0,"f":1E400,"g":100.0}', '{"k":1,"k":2,"a":{"x":1,"x":[]}}',
        '{"n":123456789012345678901234567890123456789012}', '{"\\uff5e":1,"\\ud83d\\ude00":2,"z":3}', '{"～":1,"😀":2}',
        '"\\u0001\\b\\f\\u007f / \\/"', '{"a":"\\ud800"}', "[1,2,", "", " 7 ", "NaN", '{"é":{"b":[],"a":{}}}', "[" * 3000 + "]" * 3000,
        '{"s":"1.5 and \\\\u0041"}', "9" * 5000,
    ]

    def python(text, dropped=()):
        try:
            value = json.loads(text)
            if dropped:
                value = {k: v for k, v in value.items() if k not in dropped}
            out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            out.encode()
            return out
        except (ValueError, AttributeError, RecursionError):
            return None

    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "j string")
    got = df.select(canonical_json(F.col("j")), drop_fields(F.col("j"), ["a", "k"])).collect()
    for text, row in zip(texts, got):
        assert row[0] == python(text), text[:50]
        assert row[1] == python(text, ("a", "k")), text[:50]
    assert tuple(got[-1]) == (None, None)


def test_a_file_read_by_many_tasks_keeps_its_pages(spark, tmp_path, rows):
    rng = random.Random(11)
    want, parts = [], []
    for page in range(1, 301):
        words = [f"w{page}-{i}" for i in range(rng.randrange(0, 30))]
        lines = "".join(f'<line yMin="{i}" yMax="9"><word yMin="{i}" yMax="8">{w}</word></line>' for i, w in enumerate(words))
        parts.append(f'<page number="x" width="1">\n<flow><block>{lines}</block></flow></page>\n' if words else "<page></page>")
        want += [("big", page, i, w) for i, w in enumerate(words)]
    (tmp_path / "big.xml").write_text("<html><doc>\n" + "".join(parts) + "</doc></html>")
    (tmp_path / "one.xml").write_text('<doc><page><flow><block><line yMin="1" yMax="2"><word yMin="1" yMax="2">only</word></line></block></flow></page></doc>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        words = readers.read_layout(spark, str(tmp_path / "*.xml"))
        assert spark.read.option("lineSep", "</page>").text(str(tmp_path / "big.xml")).rdd.getNumPartitions() > 5
        got = rows(words.select("source_id", "page", "line_no", "text"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([*want, ("one", 1, 0, "only")], key=repr)


def test_long_files_are_hashed_as_streams(spark, tmp_path):
    data = {f"f{i}.bin": random.Random(i).randbytes(n) for i, n in enumerate((10, 5000, 3_000_000))}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    for whole in (readers.WHOLE, 100, -1):
        got = {r.path: (r.bytes, r.sha256) for r in readers.read_files(spark, str(tmp_path / "*.bin"), whole).collect()}
        assert got == {f"file:{tmp_path}/{n}": (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}

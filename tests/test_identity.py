import hashlib
import json

from pyspark.sql import functions as F

from folioscope.functions.canonical import canonical_json, canonical_sha, drop_fields, has_non_ascii_key
from folioscope.operators import identity

DOCS = [
    {"b": 1, "a": [1, {"z": None, "y": 1.5}], "é": "ü 😀"}, {}, {"k": {"n": [[], {}]}, "t": True},
    {"big": 12345678901234567890, "s": "q\"\\/\n\t"},
]


def test_canonical_json_matches_python(spark):
    df = spark.createDataFrame([(json.dumps(d, indent=2),) for d in DOCS] + [("{broken",)], "j string")
    got = df.select(canonical_json(F.col("j")), canonical_sha(F.col("j")), drop_fields(F.col("j"), ["b", "t"])).collect()
    for doc, (text, sha, rest) in zip(DOCS, got):
        want = json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert text == want and sha == hashlib.sha256(want.encode()).hexdigest()
        left = {k: v for k, v in doc.items() if k not in ("b", "t")}
        assert rest == json.dumps(left, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got[-1][0] is None


def test_non_ascii_keys_are_flagged(spark):
    df = spark.createDataFrame([('{"é": 1}',), ('{"a": "é: x"}',)], "j string")
    assert [r[0] for r in df.select(has_non_ascii_key(F.col("j"))).collect()] == [True, False]


def population(spark, shas, partitions=3):
    df = spark.createDataFrame([("p", i, hashlib.sha256(s.encode()).hexdigest()) for i, s in enumerate(shas)], "g string, pos int, sha string")
    return df.repartition(partitions)


def test_population_digest_is_a_multiset_identity(spark):
    base = [f"r{i}" for i in range(500)] + ["copy"] * 300
    digest = lambda s, **kw: identity.population_sha(population(spark, s), ["g"], "sha", **kw).first()
    one = digest(base)
    assert one.n_records == 800
    assert digest(base[::-1]).population_sha == one.population_sha
    assert digest(base[1:] + ["other"]).population_sha != one.population_sha
    assert digest(base + ["copy"]).population_sha != one.population_sha
    assert digest(base, position="pos").population_sha != digest(base[::-1], position="pos").population_sha


def test_manifest_states(spark, rows):
    b = spark.createDataFrame([("r", "a", "1", 1), ("r", "b", "2", 1), ("r", "c", "3", 1), ("r", "c", "4", 1)], "release_id string, path string, sha256 string, bytes bigint")
    f = spark.createDataFrame([("a", "1", 1), ("c", "3", 1), ("d", "9", 1)], "path string, sha256 string, bytes bigint")
    assert rows(identity.audit_manifest(b, f)) == [
        ("a", 1, "ok"), ("b", 1, "missing"), ("c", 1, "mismatch"), ("c", 1, "ok"), ("d", 0, "undeclared")
    ]
    grown = f.withColumn("bytes", F.col("bytes") + 1)
    assert {r.status for r in identity.audit_manifest(b, grown).filter("path = 'a'").collect()} == {"mismatch"}


def test_paths(spark):
    cases = {"a/b.json": True, "": False, "/a": False, "a//b": False, "a/../b": False, "./a": False, "a\\b": False, "a/": False, "..a": True}
    df = spark.createDataFrame([(p, "0" * 64) for p in cases], "path string, sha256 string")
    assert {r.path: r.path_ok for r in identity.binding_shape(df).collect()} == cases


def test_common_bindings_need_every_value(spark):
    df = spark.createDataFrame([("g", "a", "x", "p"), ("g", "b", "x", None), ("h", "c", "y", "q"), ("h", "d", "z", "q")], "g string, own string, lock string, policy string")
    got = {r.g: (r.lock_common, r.policy_common, r.own_wrappers) for r in identity.common_bindings(df, ["g"], ["lock", "policy"], "own").collect()}
    assert got == {"g": (True, False, True), "h": (False, True, True)}


def test_registration_states(spark):
    schema = "state string, stage string, schema_version string, path string, sha256 string"
    reg = spark.createDataFrame([("s", "a", "1", "p", "h"), ("s", "b", "1", "p", "h"), ("s", "b", "1", "q", "h")], schema)
    exp = spark.createDataFrame([("s", "a", "1", "p", "h"), ("s", "a", "2", "p", "h"), ("s", "b", "1", "p", "h")], schema)
    got = {(r.stage, r.schema_version): r.status for r in identity.unique_registration(reg, exp).collect()}
    assert got == {("a", "1"): "ok", ("a", "2"): "not_exactly_one", ("b", "1"): "not_exactly_one"}
    moved = exp.withColumn("path", F.lit("elsewhere"))
    assert identity.unique_registration(reg, moved).filter("stage = 'a' and schema_version = '1'").first().status == "path_or_hash_differs"


def test_expected_counts_and_scope(spark, rows):
    actual = spark.createDataFrame([("subjects", 5), ("tasks", 2)], "k string, n bigint")
    expected = spark.createDataFrame([("subjects", 5), ("edges", 1)], "k string, n bigint")
    assert rows(identity.expect(actual, expected, ["k"], "n").select("k", "ok")) == [("edges", False), ("subjects", True), ("tasks", False)]
    parents = spark.createDataFrame([("p", "s1", None)], "parent string, src string, map string")
    kids = spark.createDataFrame([("p", "s1", None), ("p", "s2", None), ("x", "s1", None)], "parent string, src string, map string")
    assert [r.scope_ok for r in identity.scope_binding(kids, parents, "parent", ["src", "map"]).orderBy("parent", "src").collect()] == [True, False, False]

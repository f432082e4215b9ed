import json
import random

from pyspark.sql import functions as F

from folioscope.operators import diff

KEY = ["id"]


def docs(spark, items):
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in items.items()], "id string, json string")


def leaves(spark, items, **kw):
    return diff.flatten_json(docs(spark, items), KEY, "json", **kw)


def test_flatten_keeps_missing_null_and_empty_apart(spark):
    doc = {"a": None, "b": {}, "c": [], "d": {"x/y": 1, "m~n": [True, {"k": "v"}]}, "e": 1.5}
    got = {r.pointer: r.value for r in leaves(spark, {"1": doc}).collect()}
    assert got == {
        "/a": "null", "/b": "{}", "/c": "[]", "/d/x~1y": "1", "/d/m~0n/0": "true", "/d/m~0n/1/k": '"v"', "/e": "1.5"
    }
    whole = {r.pointer: r.value for r in leaves(spark, {"1": doc}, whole_arrays=True).collect()}
    assert whole["/d/m~0n"] == '[true,{"k":"v"}]'


def test_documents_are_flattened_to_the_end(spark):
    def nested(x):
        for _ in range(11):
            x = {'b"[': [x]}
        return {"1": x, "2": "[{"}

    got = diff.diff_fields(leaves(spark, nested(1)), leaves(spark, nested(2)), KEY).collect()
    assert [(r.pointer, r.before, r.after) for r in got] == [('/b"[/0' * 11, "1", "2")]


def random_doc(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.4:
        return {k: random_doc(rng, depth + 1) for k in rng.sample("abcde", rng.randint(0, 4))}
    if depth < 3 and kind < 0.55:
        return [random_doc(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 0, 7, "x", "é", ""])


def test_applied_diff_is_the_proposal(spark):
    rng = random.Random(2)
    old = {str(i): {"r": random_doc(rng)} for i in range(60)}
    new = {k: ({"r": random_doc(rng)} if rng.random() < 0.6 else v) for k, v in old.items()}
    a, b = leaves(spark, old), leaves(spark, new)
    changes = diff.diff_fields(a, b, KEY)
    assert changes.count() > 20
    assert diff.roundtrip(a, changes, b, KEY).count() == 0
    assert diff.roundtrip(a, changes.filter("id <> '3'"), b, KEY).filter("id <> '3'").count() == 0
    assert diff.roundtrip(a, changes.limit(0), b, KEY).count() == changes.count()
    assert diff.diff_fields(a, a, KEY).count() == 0


def records(spark, data):
    return spark.createDataFrame(data, "id int, name string, size int")


def test_record_and_field_diff(spark, rows):
    a = records(spark, [(1, "x", 1), (2, "y", None), (3, "z", 3)])
    b = records(spark, [(1, "x", 1), (2, "y", 5), (4, "w", 4)])
    seal = lambda d: d.withColumn("sha", F.sha2(F.to_json(F.struct("name", "size")), 256))
    assert rows(diff.diff_records(seal(a), seal(b), KEY, "sha").select("id", "status")) == [
        (1, "unchanged"), (2, "updated"), (3, "removed"), (4, "added")
    ]
    assert rows(diff.changed_fields(a, b, KEY, ["name", "size"])) == [(2, ["size"])]
    typed = [diff.flatten_fields(d, KEY, ["name", "size"]) for d in (a, b)]
    assert rows(diff.diff_fields(*typed, KEY).filter("id = 2")) == [(2, "/size", "replace", "null", "5")]


def test_later_patch_wins_and_removal_removes(spark, rows):
    base = records(spark, [(1, "a", 1), (2, "b", 2), (3, "c", 3)])
    patches = spark.createDataFrame(
        [(1, "p1", 9, "put", 1), (1, "p2", None, "put", 2), (2, None, None, "remove", 1), (4, "new", 4, "put", 1), (3, "x", 1, "put", 1), (3, None, None, "remove", 2)],
        "id int, name string, size int, action string, seq int",
    )
    assert rows(diff.compose(base, patches, KEY)) == [(1, "p2", None), (4, "new", 4)]
    one = patches.filter("id = 2").drop("seq")
    assert rows(diff.apply_patch(base, one, KEY).select("id")) == [(1,), (3,)]


def test_overlap_needs_a_rule(spark, rows):
    changes = spark.createDataFrame(
        [(1, "A", "/n", "x"), (1, "B", "/n", "y"), (1, "B", "/m", "z"), (2, "A", "/n", "x"), (2, "B", "/n", "y"), (3, "A", "/n", "s"), (3, "B", "/n", "s")],
        "id int, component string, pointer string, value string",
    )
    rules = spark.createDataFrame([(1, "/n", "B")], "id int, pointer string, component string")
    resolved, unresolved = diff.resolve_overlap(changes, rules, KEY)
    assert rows(resolved) == [(1, "/m", "z"), (1, "/n", "y"), (3, "/n", "s")]
    assert rows(unresolved.select("id", "pointer")) == [(2, "/n")]


def test_dependency_closure_counts_an_edge_once(spark):
    make = spark.createDataFrame
    rels = make([("r1", "a", "b"), ("r2", "b", "a"), ("r3", "a", "a"), ("r4", "c", "d")], "relationship_id string, source_subject_id string, target_subject_id string")
    tasks = make([("t1", "a"), ("t1", "c"), ("t2", "c")], "task_id string, subject_id string")
    facets = make([("t1", "f1", "a"), ("t2", "f1", "c"), ("t1", "f2", "c")], "task_id string, facet_id string, subject_id string")
    got = diff.dependency_closure(make([("a",)], "subject_id string"), rels, tasks, facets)
    assert sorted(r.relationship_id for r in got["relationships"].collect()) == ["r1", "r2", "r3"]
    assert [tuple(r) for r in got["facets"].collect()] == [("t1", "f1")] and got["tasks"].count() == 1


def test_opportunity_diff(spark, rows):
    old = spark.createDataFrame([("s", 1, "e1"), ("s", 1, "e2"), ("s", 2, "e3"), ("s", 3, "e4")], "subject string, page int, ev string")
    new = spark.createDataFrame([("s", 1, "e1"), ("s", 2, "e3"), ("s", 2, "e3"), ("s", 4, "e4")], "subject string, page int, ev string")
    got = rows(diff.opportunity_diff(old, new, ["subject", "page"], "ev").select("page", "status"))
    assert got == [(1, "changed"), (2, "unchanged"), (3, "removed"), (4, "added")]


def test_removals_dispute_and_win(spark, rows):
    changes = spark.createDataFrame(
        [("r", "A", "/p", None), ("r", "B", "/p", "x"), ("s", "A", "/p", None), ("s", "B", "/p", "x"),
         ("t", "A", "/p", None), ("u", "A", "/p", "x"), ("u", "B", "/p", "y")],
        "id string, component string, pointer string, value string",
    )
    rules = spark.createDataFrame(
        [("s", "/p", "A"), ("u", "/p", "A"), ("u", "/p", "B")], "id string, pointer string, component string"
    )
    resolved, unresolved = diff.resolve_overlap(changes, rules, KEY)
    assert rows(resolved) == [("s", "/p", None), ("t", "/p", None)]
    assert rows(unresolved.select("id")) == [("r",), ("u",)]


def test_unclear_records_have_a_status_of_their_own(spark, rows):
    side = "id int, sha string"
    old = spark.createDataFrame([(1, None), (2, "a"), (2, "b"), (3, None), (5, "x")], side)
    new = spark.createDataFrame([(1, None), (2, "b"), (4, None), (5, "x")], side)
    assert rows(diff.diff_records(old, new, ["id"], "sha").select("id", "status")) == [
        (1, "no_digest"), (2, "duplicate_key"), (3, "removed"), (4, "added"), (5, "unchanged")]
    patches = spark.createDataFrame([(1, "put", "a", 1), (1, "put", "b", 1), (2, "put", "a", 1), (2, "put", "a", 2)],
                                    "id int, action string, v string, seq int")
    assert rows(diff.patch_ties(patches, ["id"])) == [(1, 1, 2)]


def test_swapped_records_are_not_equal(spark):
    part = "g string, id int, w int"
    before, after = spark.createDataFrame([("a", 1, 5)], part), spark.createDataFrame([("a", 2, 5)], part)
    assert diff.population_accounting(before, after, ["g"], "w").first()["equal"]
    row = diff.population_accounting(before, after, ["g"], "w", ["id"]).first()
    assert (row.n_lost, row.n_gained, row["equal"]) == (1, 1, False)


def test_self_loop_of_a_symmetric_type(spark):
    edges = spark.createDataFrame([("a", "same", "a"), ("a", "causes", "a"), ("a", "caused_by", "a")], "source string, type string, target string")
    found = diff.edge_conflicts(edges, {"same": "same", "causes": "caused_by", "caused_by": "causes"})
    assert sorted(r.detail for r in found.filter("kind = 'reversed'").collect()) == ["caused_by", "causes"]


def test_edge_conflicts(spark, rows):
    edges = spark.createDataFrame([("a", "causes", "b"), ("b", "caused_by", "a"), ("a", "near", "b"), ("c", "causes", "d")], "source string, type string, target string")
    assert rows(diff.edge_conflicts(edges, {"causes": "caused_by", "caused_by": "causes"})) == [
        ("a", "b", "reversed", "causes"), ("a", "b", "types", "2"), ("b", "a", "reversed", "caused_by")
    ]


def test_metadata_only_rejects_a_recount(spark):
    old = {k: {"protocol": {"source_role_note": "n", "token": "t"}, "total": 100} for k in "abcd"}
    new = json.loads(json.dumps(old))
    for k in new:
        new[k]["metadata_correction"] = {"reason": "r", "refs": [1]}
    new["b"]["protocol"]["source_role_note"] = "other"
    new["c"]["total"] = 101
    new["d"]["protocol"]["token"] = "u"
    got = diff.metadata_only(leaves(spark, old), leaves(spark, new), KEY, ["/metadata_correction"], ["/protocol/source_role_note"])
    assert {r.id: r.metadata_only for r in got.collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_preserved_children_and_lineage(spark, rows):
    make = spark.createDataFrame
    kid = "parent string, child string"
    before, after = make([("p", "1"), ("p", "2"), ("p", "3")], kid), make([("p", "1"), ("p", "4"), ("p", "5")], kid)
    got = diff.preserved_children(before, after, ["parent", "child"], make([("p", "2")], kid), make([("p", "4"), ("p", "6")], kid))
    assert rows(got.select("child", "problem")) == [("3", "lost"), ("5", "unnamed_addition"), ("6", "added_but_absent")]
    mapping = make([("a", "N1", "kept"), ("b", None, "removed"), ("c", "N9", "merged")], "old_id string, new_id string, disposition string")
    got = diff.lineage_closure(make([("a",), ("b",), ("c",), ("d",)], "id string"), mapping, make([("N1",)], "id string"))
    assert rows(got) == [("N9", "target_absent"), ("d", "undisposed")]

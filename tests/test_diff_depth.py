"""Nested documents, nested disputes, repeated keys, NULL groups and long lineages."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.operators import diff, identity

KEY = ["id"]


def leaves_of(value, pointer=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves_of(v, pointer + "/" + k.replace("~", "~0").replace("/", "~1"))
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves_of(v, f"{pointer}/{i}")
    else:
        yield pointer, value


HARD = [
    {"k": "a\nb", "c": {"d": {"e": 1}}}, {"k": "ends in \\", "c": [{"x": "[{"}, "}]", {"y": {"z": '"'}}]},
    {"a/b": {"m~n": {"": 2}}}, {}, [], 3, "x", None, [[[[["deep"]]]]], {"é": {"日": [True, None]}},
]


def test_flattening_equals_python(spark):
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(HARD)], "id int, j string")
    got = {(r.id, r.pointer): json.loads(r.value) for r in diff.flatten_json(df, KEY, "j").collect()}
    assert got == {(i, p): v for i, d in enumerate(HARD) for p, v in leaves_of(d)}
    # A document's leaves do not depend on its neighbours.
    alone = diff.flatten_json(df.filter("id = 0"), KEY, "j").collect()
    assert {(r.pointer, json.loads(r.value)) for r in alone} == set(leaves_of(HARD[0]))
    bad = spark.createDataFrame([(1, "{"), (2, None)], "id int, j string")
    assert [(r.pointer, r.value) for r in diff.flatten_json(bad, KEY, "j").collect()] == [("", None)] * 2


def test_no_job_while_the_plan_is_built(spark):
    failing = spark.range(1).select(F.col("id"), F.raise_error(F.lit("read")).cast("string").alias("j"))
    diff.flatten_json(failing, KEY, "j")


def test_a_reordered_keyed_array_has_not_changed(spark):
    old = {"items": [{"id": 1, "v": "a"}, {"id": 2, "v": "b", "sub": [{"id": "x/y", "w": 1}, 7]}]}
    new = {"items": [{"sub": [{"w": 2, "id": "x/y"}, 7], "id": 2, "v": "b"}, {"id": 1, "v": "a"}]}
    make = lambda d: spark.createDataFrame([(1, json.dumps(d))], "id int, j string")
    a, b = (diff.flatten_json(make(d), KEY, "j", array_key="id") for d in (old, new))
    changes = diff.diff_fields(a, b, KEY).collect()
    assert [(r.pointer, r.before, r.after) for r in changes] == [("/items/id=2/sub/id=x~1y/w", "1", "2")]
    assert {r.place for r in b.filter("pointer = '/items/id=1/v'").collect()} == {"/items/1/v"}
    twice = {"items": [{"id": 1, "v": "a"}, {"id": 1, "v": "b"}]}
    found = diff.diff_fields(a, diff.flatten_json(make(twice), KEY, "j", array_key="id"), KEY)
    assert {r.op for r in found.filter("pointer = '/items/id=1/v'").collect()} == {"ambiguous"}


def under(outer, inner):
    return inner.startswith(outer + "/")


def test_nested_overlaps_equal_brute_force(spark, rows):
    rng = random.Random(8)
    data = {(rng.randrange(3), rng.choice("ABC"), "".join(f"/{rng.choice('ab')}" for _ in range(rng.randrange(5)))) for _ in range(60)}
    df = spark.createDataFrame(sorted(data), "id int, component string, pointer string")
    want = Counter((i, p, c, d) for i, c, p in data for j, d, q in data if i == j and c != d and under(p, q))
    assert rows(diff.nested_overlaps(df, KEY)) == sorted([(*k, n) for k, n in want.items()], key=repr)


def test_nested_disputes_need_a_rule(spark, rows):
    changes = spark.createDataFrame(
        [(1, "A", "/a", "1"), (1, "B", "/a/b", "2"), (1, "B", "/c", "3"), (2, "A", "/a", "1"), (2, "B", "/a/b", "2"), (2, "A", "/a/b/c", "4"),
         (3, "A", "/a", "1"), (3, "A", "/a/b", "2")], "id int, component string, pointer string, value string")
    rules = spark.createDataFrame([(2, "/a", "A"), (2, "/a/b", "A")], "id int, pointer string, component string")
    kept, left = diff.resolve_nested(changes, rules, KEY)
    assert rows(kept) == [(1, "/c", "3"), (2, "/a", "1"), (2, "/a/b/c", "4"), (3, "/a", "1"), (3, "/a/b", "2")]
    assert rows(left.select("id", "pointer")) == [(1, "/a"), (1, "/a/b")]


def test_a_key_held_twice_is_reported(spark, rows):
    side = "id int, name string"
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], side), spark.createDataFrame([(1, "b"), (2, "y")], side)
    assert rows(diff.changed_fields(old, new, KEY, ["name"])) == [(1, ["*duplicate_key"]), (2, ["name"])]
    base = spark.createDataFrame([(1, "s"), (1, "t"), (2, "s"), (3, None)], "id int, sha string")
    patch = spark.createDataFrame([(1, "s"), (2, "s"), (3, None), (4, None), (2, "old")], "id int, before_sha string")
    got = diff.guard_before(base, patch, KEY, "sha").select("id", "before_sha", "valid", "n_base")
    assert rows(got) == [(1, "s", False, 2), (2, "old", False, 1), (2, "s", True, 1), (3, None, False, 1), (4, None, True, 0)]


def test_two_last_patches_are_refused(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    make = lambda d: spark.createDataFrame(d, "id int, v string, action string, seq int")
    earlier = make([(1, "x", "put", 1), (1, "y", "put", 1), (1, "z", "put", 2), (2, "c", "put", 1), (2, "c", "put", 1)])
    assert rows(diff.compose(base, earlier, KEY)) == [(1, "z"), (2, "c")]
    with pytest.raises(Exception, match="several last patches"):
        diff.compose(base, make([(1, "x", "put", 1), (1, "y", "put", 1)]), KEY).collect()


def test_null_groups_and_digests(spark):
    part = "g string, id int, w int"
    before = spark.createDataFrame([(None, 1, 5), ("a", 2, 5), ("b", 3, 1), ("b", 3, 1)], part)
    after = spark.createDataFrame([(None, 1, 5), ("a", 4, 5), ("b", 3, 2)], part)
    got = {r.g: r for r in diff.population_accounting(before, after, ["g"], "w", ["id"]).collect()}
    assert got[None]["equal"] and got[None].sha_before == got[None].sha_after
    assert not got["a"]["equal"] and (got["a"].n_lost, got["a"].n_gained) == (1, 1)
    # One record of weight 2 is not two records of weight 1.
    assert got["b"].weight_before == got["b"].weight_after and not got["b"]["equal"]


def test_an_updated_state_is_that_of_the_new_population(spark, rows):
    rng = random.Random(9)
    shas = [f"{rng.getrandbits(256):064x}" for _ in range(60)] + ["f" * 64] * 3
    make = lambda d: spark.createDataFrame(d, "g string, sha string")
    before = [(rng.choice("ab"), s) for s in shas]
    gone, new = before[::3], [("a", "0" * 64), ("c", shas[0]), ("a", shas[1])]
    after = list((Counter(before) - Counter(gone) + Counter(new)).elements())
    state = identity.multiset_state(make(before), ["g"], "sha")
    updated = identity.update_state(state, make(new), make(gone), ["g"], "sha")
    scratch = identity.multiset_state(make(after), ["g"], "sha")
    assert updated.schema == scratch.schema or [f.dataType for f in updated.schema] == [f.dataType for f in scratch.schema]
    assert rows(identity.population_digest(updated, ["g"])) == rows(identity.population_digest(scratch, ["g"]))


def test_snapshot_and_bundle_report_what_is_unclear(spark, rows):
    side = "path string, sha256 string"
    before = spark.createDataFrame([("a", None), ("b", "1"), ("c", "1")], side)
    after = spark.createDataFrame([("a", None), ("b", "1"), ("d", "1")], side)
    assert rows(identity.unchanged(before, after)) == [("a", "unknown"), ("b", "unchanged"), ("c", "gone"), ("d", "new")]
    members = spark.createDataFrame([("z", "n", "h2"), ("z", "m", "h1")], "archive string, name string, sha256 string")
    declared = spark.createDataFrame([("z", "n", "p"), ("z", "m", "q")], "archive string, name string, artifact_path string")
    bindings = spark.createDataFrame([("p", "h1"), ("p", "h2"), ("q", "h1"), ("q", "h1")], side)
    assert rows(identity.audit_bundle(members, declared, bindings).select("name", "status")) == [("m", "ok"), ("n", "conflict")]


def test_lineage_over_many_versions(spark):
    rng = random.Random(10)
    steps = {(f"{v}:{i}", None if rng.random() < 0.1 else f"{v + 1}:{i if rng.random() < 0.6 else rng.randrange(12)}")
             for v in range(10) for i in range(12) for _ in range(1 + (rng.random() < 0.2))}
    steps |= {("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("into", "r1"), ("s", "s")}
    after = defaultdict(set)
    for a, b in steps:
        after[a].add(b)

    def paths(node, n=0):
        if n > 40:
            return Counter({("cycle", 0): 1})
        out = Counter()
        for b in after[node]:
            if b in after:
                out += paths(b, n + 1)
            else:
                out[b, n + 1] += 1
        return out

    got = defaultdict(dict)
    for r in diff.lineage_chains(spark.createDataFrame(sorted(steps, key=repr), "old_id string, new_id string")).collect():
        got[r.id][r.final_id] = (r.status, r.n_paths, r.n_steps)
    assert {n for n, ends in got.items() if any(e[0] == "cycle" for e in ends.values())} == {"r1", "r2", "r3", "into", "s"}
    for node in after:
        if not node[0].isdigit():
            continue
        count, longest = Counter(), defaultdict(int)
        for (end, n), k in paths(node).items():
            count[end] += k
            longest[end] = max(longest[end], n)
        assert got[node] == {e: ("removed" if e is None else "current", count[e], longest[e]) for e in count}


def test_lineage_rounds_move_only_what_goes_on(spark, monkeypatch):
    """Ended chains stay out of later rounds; a ring alone needs those."""
    sizes, cut = [], diff.cut_lineage

    def spy(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(diff, "cut_lineage", spy)
    steps = [(f"{v}:{i}", f"{v + 1}:{i}") for v in range(4) for i in range(50)] + [("r1", "r2"), ("r2", "r1")]
    got = {r.id: r for r in diff.lineage_chains(spark.createDataFrame(steps, "old_id string, new_id string")).collect()}
    assert len(got) == 202 and {n for n, r in got.items() if r.status == "cycle"} == {"r1", "r2"}
    assert all(got[f"{v}:{i}"].final_id == f"4:{i}" and got[f"{v}:{i}"].n_steps == 4 - v for v in range(4) for i in range(50))
    assert len(sizes) > 8 and sizes[-3:] == [2, 2, 2]


def test_nested_disputes_are_made_once(spark):
    """Neither result makes changes or disputes anew; pointers are taken apart before both."""
    rows = [("a", "x", "/p", "1"), ("a", "y", "/p/q", "2"), ("a", "x", "/r", "3")]
    changes = spark.createDataFrame(rows, "k string, component string, pointer string, value string")
    rules = spark.createDataFrame([("a", "/p", "x")], "k string, pointer string, component string")
    kept, left = diff.resolve_nested(changes, rules, ["k"])
    assert {r.pointer for r in kept.collect()} == {"/p", "/r"} and left.count() == 0
    for out in (kept, left):
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_lineage_chains_broadcast_nothing_and_rounds_follow_the_chains(spark, monkeypatch):
    """Steps may be many times the table they are made of, so no join may send them whole; rings of
    three in many chains don't ask for as many rounds as there are doublings up to the number of ids."""
    cuts, cut = [], diff.cut_lineage
    monkeypatch.setattr(diff, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    steps = [(f"{v}:{i}", f"{v + 1}:{i}" if v < 3 else None) for v in range(4) for i in range(300)]
    steps += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "s"), ("s", "t"), ("t", "s"), ("u", "v"), ("v", "w"), ("w", "x"), ("x", "r2")]
    mapping = spark.createDataFrame(steps, "old_id string, new_id string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        got = diff.lineage_chains(mapping).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert {r.id for r in got if r.status == "cycle"} == {"r1", "r2", "r3", "s", "t", "u", "v", "w", "x"}
    assert all(r.final_id in {"r1", "r2", "r3", "s", "t"} for r in got if r.status == "cycle")
    assert {(r.id, r.n_steps) for r in got if r.status == "removed"} == {(f"{v}:{i}", 4 - v) for v in range(4) for i in range(300)}
    assert len(cuts) < 13

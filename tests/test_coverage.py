import datetime as dt
import random

from pyspark.sql import functions as F

from folioscope.functions.ranking import bucketed_position, range_join
from folioscope.functions.skew import hot_join
from folioscope.operators import coverage


def test_position_equals_row_number(spark):
    rng = random.Random(4)
    data = [("hot", i) for i in rng.sample(range(5000), 900)] + [(f"g{i % 7}", i) for i in rng.sample(range(-300, 5000), 400)]
    data += [("sparse", rng.randint(-(2**62), 2**62)) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, o bigint")
    for levels in (1, 2, 4):
        got = {(r.g, r.o): r.pos for r in bucketed_position(df, ["g"], "o", "pos", width=16, levels=levels).collect()}
        for g in {g for g, _ in data}:
            for i, o in enumerate(sorted({o for h, o in data if h == g})):
                assert got[(g, o)] == i + 1


def test_hot_join_equals_join(spark, rows):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), i) for i in range(200)]
    big = spark.createDataFrame(data, "k string, i int")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low")).filter("k is null or k <> 'c'")
    low = {r.k: r.low for r in small.collect()}
    inner = sorted([(k, i, low[k]) for k, i in data if k in low], key=repr)
    assert rows(hot_join(big, small, ["k"], "n")) == inner
    left = rows(hot_join(big, small, ["k"], "n", "left"))
    assert left == sorted([(k, i, low.get(k)) for k, i in data], key=repr)


def test_dangling_keeps_every_row(spark, rows):
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, "x"), (4, None)], "id int, ref string")
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(coverage.dangling(child, parent, ["ref"], ["k"])) == [(2, "x"), (3, "x"), (4, None)]


def test_range_join_equals_brute_force(spark, rows):
    rng = random.Random(9)
    points = [(rng.choice("ab"), rng.randint(0, 400)) for _ in range(200)]
    ranges = [(rng.choice("ab"), lo, lo + rng.randint(0, 90), f"r{i}") for i, lo in enumerate(rng.sample(range(400), 30))]
    p = spark.createDataFrame(points, "g string, x bigint")
    r = spark.createDataFrame(ranges, "g string, lo bigint, hi bigint, name string")
    got = rows(range_join(p, r, ["g"], "x", "lo", "hi", width=32).select("g", "x", "name"))
    assert got == sorted([(g, x, n) for g, x in points for h, lo, hi, n in ranges if g == h and lo <= x <= hi], key=repr)
    assert range_join(p, r.filter("false"), ["g"], "x", "lo", "hi", how="left").count() == 200


def test_ranges_of_every_length(spark, rows):
    ranges = [("a", 0, 3 * 10**12, "huge"), ("a", 5, 9, "tiny"), ("b", -(2**62), 2**62, "all"), ("b", 9, 5, "reversed"),
              ("a", 10**12, 10**12 + 50_000, "middle")]
    points = [(g, x) for g in "abc" for x in (-1, 0, 7, 10**12 + 7, 3 * 10**12, 3 * 10**12 + 1, 2**62)]
    p = spark.createDataFrame(points, "g string, x bigint")
    r = spark.createDataFrame(ranges, "g string, lo bigint, hi bigint, name string")
    want = [(g, x, n) for g, x in points for h, lo, hi, n in ranges if g == h and lo <= x <= hi]
    assert rows(range_join(p, r, ["g"], "x", "lo", "hi").select("g", "x", "name")) == sorted(want, key=repr)
    alone = [(g, x, None) for g, x in points if not any(w[:2] == (g, x) for w in want)]
    assert rows(range_join(p, r, ["g"], "x", "lo", "hi", how="left").select("g", "x", "name")) == sorted(want + alone, key=repr)


def test_same_child_id_under_two_parents(spark):
    df = spark.createDataFrame([("t1", "f1"), ("t2", "f1")], "task string, facet string")
    assert coverage.dupes(df, ["task", "facet"]).count() == 0
    assert coverage.union_accounting(df, ["facet"]).first().duplicate_bindings == 1


def test_closure_lists_missing_and_extra(spark, rows):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(coverage.closure(a, b, ["k"])) == [(1, "missing"), (3, "extra")]
    assert rows(coverage.partition_check(b.union(b), a.distinct(), ["k"])) == [(1, "missing", 0), (2, "overlap", 2), (3, "extra", 2)]


def test_null_keys_meet_each_other(spark):
    a = spark.createDataFrame([(None,), (1,)], "k int")
    assert coverage.closure(a, a, ["k"]).count() == 0


def test_canonicalize_states(spark, rows):
    df = spark.createDataFrame(
        [("k1", "v", 4), ("k1", "v", 9), ("k2", "v", 1), ("k2", "w", 2), ("k3", "v", 7)], "k string, v string, pos int"
    )
    canonical = coverage.canonicalize(df, ["k"], "v", "pos")
    assert rows(canonical.select("k", "multiplicity", "first_position", "last_position", "status")) == [
        ("k1", 2, 4, 9, "identical"), ("k2", 2, 1, 2, "conflict"), ("k3", 1, 7, 7, "single")
    ]
    assert coverage.occurrence_positions(df, canonical, ["k"], "pos").count() == 4


def test_crosswalk_shapes(spark):
    pairs = [("a", 1), ("b", 2), ("b", 3), ("c", 4), ("d", 4), ("e", 5), ("e", 6), ("f", 6), ("a", 1)]
    got = {(r.old, r.new): r.shape for r in coverage.crosswalk_shape(spark.createDataFrame(pairs, "old string, new int"), "old", "new").collect()}
    assert got == {
        ("a", 1): "equivalent", ("b", 2): "split", ("b", 3): "split", ("c", 4): "merge", ("d", 4): "merge",
        ("e", 5): "split", ("e", 6): "changed_boundary", ("f", 6): "merge",
    }


def test_near_duplicates(spark):
    labels = [(1, "Terror, The"), (2, "The Terror"), (3, "the  terror!"), (4, "White Terror"), (5, "The Terror")]
    df = spark.createDataFrame([("s", i, t) for i, t in labels], "s string, id int, label string")
    got = {(r.kind, r.n_labels, r.n_forms, r.first_id) for r in coverage.near_dupes(df, ["s"], "label", "id").collect()}
    assert got == {("exact", 3, 1, 2), ("near", 4, 2, 1)}


def independence(spark, author="a", reviewer="b", seen=(False, False), reviewed=("d1", "d2")):
    make = spark.createDataFrame
    o = make([("o", author, seen[0])], "overlay_id string, author_id string, candidate_seen boolean")
    r = make([("o", reviewer, seen[1])], "overlay_id string, reviewer_id string, candidate_seen boolean")
    ids = "overlay_id string, delta_id string"
    d, v = make([("o", "d1"), ("o", "d2")], ids), make([("o", x) for x in reviewed], ids)
    return coverage.independence(o, r, d, v).first().ok


def test_independence_mutations(spark):
    assert independence(spark)
    assert not independence(spark, reviewer="a")
    assert not independence(spark, seen=(False, True))
    assert not independence(spark, reviewed=[])
    assert not independence(spark, reviewed=["d1", "d2", "d3"])
    assert not independence(spark, reviewed=["d1"])


def test_chronology(spark, rows):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame(
        [("a", "receipt", t(2), 1), ("a", "proposal", t(3), 2), ("a", "proposal", t(2), 3), ("b", "proposal", t(5), 4)],
        "scope string, kind string, ts timestamp, event_id int",
    )
    got = rows(coverage.chronology(events, {"proposal": ["receipt"]}, ["scope"]).select("event_id", "problem"))
    assert got == [(3, "too_early"), (4, "no_prerequisite")]


def test_first_page_and_followers(spark, rows):
    ev = spark.createDataFrame([("s1", 50), ("s1", 7), ("s2", 44), ("s3", 900)], "subject string, page int")
    buckets = spark.createDataFrame([("A", 1, 43), ("B", 44, 99)], "bucket string, lo int, hi int")
    assigned = coverage.assign_by_first_page(ev, buckets, [], "subject", "page", width=8)
    assert rows(assigned.select("subject", "bucket")) == [("s1", "A"), ("s2", "B"), ("s3", None)]
    kids = spark.createDataFrame([("s1", "e1"), ("s2", "e2")], "subject string, child string")
    assert rows(coverage.follow_parent(kids, assigned, ["subject"]).select("child", "bucket")) == [("e1", "A"), ("e2", "B")]


def test_subset_forms_agree(spark):
    facets = spark.createDataFrame([("t", "f1", [1, 2]), ("t", "f2", [1, 9]), ("u", "f1", [5])], "task string, facet string, ids array<bigint>")
    tasks = spark.createDataFrame([("t", [1, 2, 3])], "task string, ids array<bigint>")
    records = {(r.task, r.facet): r.subset_ok for r in coverage.facet_subset(facets, tasks, ["task"], "ids").collect()}
    long = coverage.facet_subset_bindings(
        facets.withColumn("id", F.explode("ids")), tasks.withColumn("id", F.explode("ids")), ["task"], "facet", "id"
    )
    assert records == {(r.task, r.facet): r.subset_ok for r in long.collect()}
    assert records == {("t", "f1"): True, ("t", "f2"): False, ("u", "f1"): False}


def test_scope_and_required(spark, rows):
    nested = spark.createDataFrame([("e", 5), ("e", 6), ("f", 1)], "parent string, page int")
    evidence = spark.createDataFrame([("e", 5)], "parent string, page int")
    assert rows(coverage.page_scope(nested, evidence, ["parent"], "page")) == [("e", 6), ("f", 1)]
    owners = spark.createDataFrame([("e", 5, 5), ("f", 0, 3)], "parent string, lo int, hi int")
    assert rows(coverage.page_range_scope(nested, owners, ["parent"], "page")) == [("e", 6)]
    recs = spark.createDataFrame([(1, "x", " "), (2, None, "y"), (3, "x", "y")], "id int, a string, b string")
    assert rows(coverage.empty_required(recs, ["id"], ["a", "b"])) == [(1, ["b"]), (2, ["a"])]

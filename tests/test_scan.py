import datetime as dt
import random

from folioscope.functions.scan import scan
from folioscope.operators import coverage, intervals


def test_scan_equals_a_loop(spark):
    rng = random.Random(5)
    data = sorted({(rng.choice(["hot"] * 6 + ["a", None]), rng.randrange(10_000)): rng.randrange(-50, 50) for _ in range(900)}.items(), key=repr)
    df = spark.createDataFrame([(g, o, v) for (g, o), v in data], "g string, o int, v int").repartition(5)
    for parts in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = scan(df, ["g"], ["o"], sums={"s": "v"}, maxima={"m": "v"}, following={"n": "o", "w": "v"}).collect()
        got = {(r.g, r.o): (r.s, r.m, r.n, r.w) for r in out}
        assert len(got) == len(data)
        for g in ("hot", "a", None):
            rows = sorted((o, v) for (h, o), v in data if h == g)
            for i, (o, _) in enumerate(rows):
                earlier = [v for _, v in rows[:i]]
                after = rows[i + 1] if i + 1 < len(rows) else (None, None)
                assert got[g, o] == (sum(earlier), max(earlier, default=None), *after)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_long_step_breaks_all_that_begin_inside_it(spark):
    events = [("x", 1, 0), ("x", 1, 100), ("x", 2, 10), ("x", 2, 20), ("x", 3, 50), ("x", 3, 60), ("x", 9, 100), (None, 1, 5), (None, 2, 4)]
    got = coverage.sequence_breaks(spark.createDataFrame(events, "s string, step int, t int"), ["s"], "step", "t").collect()
    assert sorted((r.s or "", r.step) for r in got) == [("", 2), ("x", 2), ("x", 3)]


def test_latest_prerequisite(spark):
    rng = random.Random(6)
    day = dt.datetime(2024, 1, 1)
    events = [(rng.choice("ab"), rng.choice(["view", "click", "signup", "buy", "other"]), day + dt.timedelta(minutes=rng.randrange(40)), i)
              for i in range(200)]
    rules = {"click": ["view"], "buy": ["signup", "click"], "view": ["view"]}
    got = {(r.event_id, r.prerequisite): r.ready_id
           for r in coverage.latest_prerequisite(spark.createDataFrame(events, "u string, kind string, ts timestamp, event_id int"), rules, ["u"]).collect()}
    want = {}
    for u, kind, ts, i in events:
        for need in rules.get(kind, []):
            before = [(t, j) for v, k, t, j in events if v == u and k == need and t < ts]
            want[i, need] = max(before)[1] if before else None
    assert got == want


def test_intervals_equal_pages(spark):
    rng = random.Random(7)

    def drawn(n):
        return [(rng.choice(["a", "b", None]), lo, lo + rng.randrange(-2, 12)) for lo in (rng.randrange(80) for _ in range(n))]

    ranges, whole = drawn(30), drawn(6)
    frames = [spark.createDataFrame(x, "s string, lo int, hi int") for x in (ranges, whole)]
    count = {kind: {(s, p): sum(g == s and lo <= p <= hi for g, lo, hi in x) for s in ("a", "b", None) for p in range(-5, 120)}
             for kind, x in (("r", ranges), ("w", whole))}
    pages = {}
    for r in intervals.interval_coverage(*frames, ["s"], "lo", "hi").collect():
        for p in range(r.first, r.last + 1):
            assert (r.s, p) not in pages
            pages[r.s, p] = (r.depth, r.problem)
    want = {}
    for k, depth in count["r"].items():
        due = count["w"][k]
        if (depth and not due) or (due and depth != 1):
            want[k] = (depth, "outside" if not due else "gap" if not depth else "overlap")
    assert pages == want
    for r in intervals.interval_progress(*frames, ["s"], "lo", "hi").collect():
        due = [p for (s, p), n in count["w"].items() if s == r.s and n]
        left = [p for p in due if not count["r"][r.s, p]]
        assert (r.n_pages, r.n_open, r.n_inspected, r.next_page, r.complete) == (
            len(due), len(left), len(due) - len(left), min(left, default=None), not left)


def test_huge_ranges_give_gaps_as_ranges(spark):
    far = 10**12
    ranges = spark.createDataFrame([("s", 0, far), ("s", far - 5, far + 5), ("s", far + 100, 3 * far)], "s string, lo bigint, hi bigint")
    whole = spark.createDataFrame([("s", 0, 4 * far)], "s string, lo bigint, hi bigint")
    got = sorted((r.first, r.last, r.problem) for r in intervals.interval_coverage(ranges, whole, ["s"], "lo", "hi").collect())
    assert got == [(far - 5, far, "overlap"), (far + 6, far + 99, "gap"), (3 * far + 1, 4 * far, "gap")]

import itertools
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from folioscope.functions.numbers import ratio
from folioscope.operators import evaluate
from folioscope.plans.evaluation import evaluate_candidates

SCHEMA = (
    "candidate_id string, path_id string, locator_id string, treatment string, fit string, judgment string, "
    "keep string, inspected boolean"
)
CREDITS = {"substantive": 4, "mixed": 2, "weak": 0}


def locators(spark, axes, candidate="c"):
    return spark.createDataFrame([(candidate, "p", f"l{i}", *a, True) for i, a in enumerate(axes)], SCHEMA)


def half_up(num, den):
    return None if den == 0 else (Decimal(num) / Decimal(den)).quantize(Decimal("0.000001"), ROUND_HALF_UP)


def test_ratio_rounds_once(spark):
    pairs = [(1, 3), (2, 3), (1, 8_000_000), (5, 10_000_000), (0, 7), (3, 0), (10**15, 3), (7, 7)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    assert [r[0] for r in df.select(ratio(F.col("n"), F.col("d"))).collect()] == [half_up(n, d) for n, d in pairs]


def test_world_table():
    worlds = evaluate.world_table()
    assert len(worlds) == 15
    assert all(w["fit"] == "no_fit" for w in worlds if w["treatment"] == "absent")
    assert all(w["keep"] == "not_kept" for w in worlds if w["treatment"] == "weak" or w["fit"] != "exact_fit")


CASES = [
    # one judgment left; only non-keep judgments left; kept and not kept left
    (("absent", None, None, None), "unsupported"),
    (("mixed", "exact_fit", "supported", "kept"), "supported"),
    (("weak", None, None, None), "not_kept_subtype_unresolved"),
    ((None, None, None, "not_kept"), "not_kept_subtype_unresolved"),
    (("substantive", "exact_fit", None, None), "semantic_unresolved"),
    ((None, None, None, None), "semantic_unresolved"),
    (("absent", "exact_fit", None, None), "inconsistent"),
    (("unavailable", None, None, None), "uninspectable"),
    (("unavailable", "exact_fit", None, None), "inconsistent"),
    (("mixed", "material_partial_fit", None, None), "partially_supported"),
    (("mixed", "no_fit", None, None), "unsupported"),
]


def test_judgment_classes(spark):
    got = evaluate.judgment_class(locators(spark, [a for a, _ in CASES])).collect()
    by_id = {r.locator_id: r.judgment_class for r in got}
    assert [by_id[f"l{i}"] for i in range(len(CASES))] == [c for _, c in CASES]


def test_forced_values_are_reported(spark):
    rows = [("mixed", "no_fit", None, None), (None, "exact_fit", "supported", "kept"), ("absent", None, "unsupported", "not_kept"), ("weak", "exact_fit", "supported", "kept")]
    got = {(r.locator_id, r.problem, r.axis, r.forced) for r in evaluate.validate_axes(locators(spark, rows)).collect()}
    assert got == {
        ("l0", "forced", "judgment", "unsupported"), ("l0", "forced", "keep", "not_kept"),
        ("l2", "forced", "fit", "no_fit"), ("l3", "inconsistent", None, None),
    }


def test_blockers_name_open_axes(spark):
    rows = [("weak", None, None, "not_kept"), ("substantive", "exact_fit", None, None), (None, "exact_fit", "supported", "kept"), ("mixed", "exact_fit", "supported", "kept")]
    got = {r.locator_id: r.unresolved_axes for r in evaluate.blockers(locators(spark, rows)).collect()}
    assert got == {"l0": ["fit", "judgment"], "l1": ["keep"], "l2": ["treatment"]}


def test_keep_bounds(spark):
    rows = [("mixed", "exact_fit", "supported", "kept")] * 2 + [("weak", None, None, "not_kept"), ("substantive", "exact_fit", None, None)]
    b = evaluate.keep_bounds(locators(spark, rows), ["candidate_id"]).first()
    assert (b.n_locators, b.n_resolved, b.lower, b.central, b.upper, b.resolved_only) == (
        4, 3, Decimal("0.500000"), None, Decimal("0.750000"), Decimal("0.666667")
    )
    settled = evaluate.keep_bounds(locators(spark, rows[:3]), ["candidate_id"]).first()
    assert settled.lower == settled.central == settled.upper == Decimal("0.666667")


def brute_envelope(rows):
    """Every combination of consistent worlds of every row."""
    worlds = evaluate.world_table()
    options = []
    for row in rows:
        fits = [w for w in worlds if all(v is None or w[a] == v for a, v in zip(evaluate.AXES, row))]
        if fits:
            options.append(sorted({w["treatment"] for w in fits}))
    results, empty = [], False
    for choice in itertools.product(*options):
        counted = [CREDITS[t] for t in choice if t != "absent"]
        if counted:
            results.append(half_up(sum(counted), len(counted)))
        else:
            empty = True
    return (min(results) if results else None, max(results) if results else None, empty)


def test_envelope_equals_enumeration(spark):
    rng = random.Random(11)
    cases, data = {}, []
    for c in range(60):
        rows = [tuple(rng.choice(vals + [None] * k) for vals, k in (
            (evaluate.TREATMENTS, 3), (evaluate.FITS, 3), (evaluate.JUDGMENTS, 3), (evaluate.KEEPS, 3))) for _ in range(rng.randint(1, 6))]
        cases[f"c{c}"] = rows
        data += [(f"c{c}", "p", f"l{i}", *r, True) for i, r in enumerate(rows)]
    got = evaluate.selectivity_envelope(spark.createDataFrame(data, SCHEMA), CREDITS, ["candidate_id"]).collect()
    for r in got:
        lower, upper, empty = brute_envelope(cases[r.candidate_id])
        assert (r.lower, r.upper) == (lower, upper)
        assert r.may_be_empty == (empty or lower is None)
        assert r.central == (lower if lower == upper and not r.may_be_empty else None)


def test_gates_use_known_premises_only(spark):
    rules = {"wrong_locator": {"premises": {"fit": "no_fit", "keep": "not_kept"}, "at_least": 2}}
    rows = [("mixed", "no_fit", "unsupported", "not_kept"), (None, "no_fit", "unsupported", "not_kept"), ("mixed", None, None, "not_kept"), ("mixed", "exact_fit", None, None)]
    g = evaluate.gates(locators(spark, rows), rules, ["candidate_id"]).first()
    assert (g.n_confirmed, g.n_possible, g.fires, g.may_fire) == (2, 3, True, True)
    g = evaluate.gates(locators(spark, rows[1:]), rules, ["candidate_id"]).first()
    assert (g.n_confirmed, g.fires, g.may_fire) == (1, False, True)


@pytest.mark.parametrize("validity, sufficient, gated, authority, readiness", [
    ("valid", False, True, "indeterminate", "not_ready"), ("valid", False, False, "indeterminate", "indeterminate"),
    ("valid", True, False, "authoritative", "ready"), ("valid", True, True, "authoritative", "not_ready"),
    ("invalid", False, False, "invalid", "indeterminate"), ("invalid", True, True, "invalid", "not_ready"),
    ("indeterminate", True, False, "indeterminate", "indeterminate"), ("valid", None, None, "indeterminate", "indeterminate"),
])
def test_outcome_precedence(spark, validity, sufficient, gated, authority, readiness):
    df = spark.createDataFrame([("c", validity, sufficient, gated)], "candidate_id string, validity string, sufficient boolean, gated boolean")
    decisions = spark.createDataFrame([("c", "approved")], "candidate_id string, human_decision string")
    r = evaluate.outcomes(df, decisions).first()
    assert (r.authority, r.readiness, r.human_decision) == (authority, readiness, "approved")


def test_recall_counts_units_once(spark):
    units = spark.createDataFrame([("b", "s", 1, "principal"), ("b", "s", 1, "principal"), ("b", "s", 2, "principal"), ("b", "t", 2, "supporting")], "source_id string, subject string, page int, locator_class string")
    routes = spark.createDataFrame([("c", "b", "s", 1, True), ("c", "b", "s", 1, True), ("c", "b", "t", 2, False)], "candidate_id string, source_id string, subject string, page int, valid boolean")
    cands = spark.createDataFrame([("c", "b"), ("d", "b")], "candidate_id string, source_id string")
    match = ["source_id", "subject", "page"]
    got = {(r.candidate_id, r.locator_class): (r.n_found, r.n_units) for r in evaluate.treatment_recall(units, routes, cands, match).collect()}
    assert got == {("c", "principal"): (1, 2), ("c", "supporting"): (0, 1), ("d", "principal"): (0, 2), ("d", "supporting"): (0, 1)}


def test_continuation_needs_a_row(spark, rows):
    routes = spark.createDataFrame([("s", 100), ("s", 200)], "subject string, page int")
    cont = spark.createDataFrame([("s", 100)], "subject string, page int")
    assert rows(evaluate.routes_with_continuation(routes, cont, ["subject"]).select("page", "kind")) == [
        (100, "direct"), (101, "continued"), (200, "direct")
    ]


def test_parents_and_requirements(spark, rows):
    reqs = spark.createDataFrame([("a", "met"), ("a", "met"), ("b", "met"), ("b", "not_met"), ("c", "not_met"), ("d", "met"), ("d", "unresolved")], "parent string, disposition string")
    assert rows(evaluate.parent_coverage(reqs, ["parent"]).select("parent", "coverage")) == [
        ("a", "found"), ("b", "partial"), ("c", "missing"), ("d", "unresolved")
    ]
    inv = spark.createDataFrame([("p", "r1", "h", 1), ("p", "r1", "h", 2), ("p", "r2", "h", 3), ("p", "r2", "g", 4), ("p", "r3", "h", 5)], "parent string, req string, sha string, pos int")
    got = spark.createDataFrame([("p", "r1"), ("p", "r2"), ("p", "r9")], "parent string, req string")
    assert rows(evaluate.requirement_closure(inv, got, ["parent", "req"], "sha", "pos").select("req", "problem")) == [
        ("r2", "conflict"), ("r3", "missing"), ("r9", "extra")
    ]


def test_no_readiness_without_evidence(spark):
    sure, wrong = ("mixed", "exact_fit", "supported", "kept"), ("absent", "no_fit", "unsupported", "not_kept")
    data = [
        ("unmeasured", "p", "l", *sure, None), ("partly", "p", "l", *sure, True), ("partly", "p", "m", *sure, None),
        ("unseen", "p", "l", *sure, True), ("unseen", "p", "m", *wrong, False),
    ]
    names = ("unmeasured", "partly", "unseen", "nothing")
    cands = spark.createDataFrame([(c, "valid") for c in names], "candidate_id string, validity string")
    rules = {"wrong_locator": {"premises": {"treatment": "absent"}, "at_least": 1}}
    fit = {"exact_fit": 2, "material_partial_fit": 1, "no_fit": 0}
    out = {r.candidate_id: r for r in evaluate_candidates(spark.createDataFrame(data, SCHEMA), cands, rules, fit, CREDITS).collect()}
    assert set(out) == set(names)
    assert all((r.authority, r.readiness, r.gated) == ("indeterminate", "indeterminate", False) for r in out.values())
    assert (out["unseen"].validity, out["partly"].validity) == ("indeterminate", "valid")


def test_candidates_end_to_end(spark):
    sure = [("mixed", "exact_fit", "supported", "kept")] * 3
    data = [("ok", "p", f"l{i}", *a, True) for i, a in enumerate(sure)]
    data += [("open", "p", f"l{i}", *a, True) for i, a in enumerate([*sure, ("substantive", "exact_fit", None, None)])]
    data += [("bad", "p", f"l{i}", *a, True) for i, a in enumerate([*sure, ("absent", "no_fit", "unsupported", "not_kept")])]
    cands = spark.createDataFrame([(c, "valid") for c in ("ok", "open", "bad", "empty")], "candidate_id string, validity string")
    rules = {"wrong_locator": {"premises": {"treatment": "absent"}, "at_least": 1}}
    fit = {"exact_fit": 2, "material_partial_fit": 1, "no_fit": 0}
    out = {r.candidate_id: r for r in evaluate_candidates(spark.createDataFrame(data, SCHEMA), cands, rules, fit, CREDITS).collect()}
    assert (out["ok"].authority, out["ok"].readiness, out["ok"].precision) == ("authoritative", "ready", Decimal("1.000000"))
    assert (out["open"].authority, out["open"].readiness, out["open"].precision) == ("indeterminate", "indeterminate", None)
    assert (out["bad"].authority, out["bad"].readiness) == ("authoritative", "not_ready")
    assert (out["empty"].authority, out["empty"].readiness) == ("indeterminate", "indeterminate")
    assert out["bad"].selectivity_lower == Decimal("2.000000")

"""Evaluation arithmetic with explicit uncertainty.

``locators(candidate_id, path_id, locator_id, page, treatment, fit, keep,
judgment, inspected, in_scope)``; a NULL axis is unresolved. ``inspected`` is
false for a physically uninspectable row and NULL for a row not measured.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.numbers import ratio
from folioscope.functions.ranking import explode_range
from folioscope.functions.skew import hot_join
from folioscope.operators.coverage import canonicalize, closure
from folioscope.session import cut_lineage

# The axes and their settled states.
TREATMENTS = ["substantive", "mixed", "weak", "absent"]
FITS = ["exact_fit", "material_partial_fit", "no_fit"]
JUDGMENTS = ["supported", "partially_supported", "unsupported"]
KEEPS = ["kept", "not_kept"]
AXES = ["treatment", "fit", "judgment", "keep"]

UNKNOWN = "?"
# Fixed value: the treatment of a row that physically can't be inspected. It is no
# semantic state, so it takes part in no world of the other axes.
UNAVAILABLE = "unavailable"


def is_unavailable() -> Column:
    """A row recorded as unavailable; with any other axis settled it contradicts itself."""
    others = F.col("fit").isNull() & F.col("judgment").isNull() & F.col("keep").isNull()
    return F.coalesce((F.col("treatment") == UNAVAILABLE) & others, F.lit(False))


def world_table() -> list[dict[str, str]]:
    """Every consistent combination of settled axis values, from the invariants.

    absent needs no_fit; a partial fit is partially_supported; no_fit is
    unsupported; a weak treatment is never supported.
    """
    worlds = []
    for treatment, fit, judgment in product(TREATMENTS, FITS, JUDGMENTS):
        consistent = (
            (treatment != "absent" or fit == "no_fit")
            and (fit != "material_partial_fit" or judgment == "partially_supported")
            and (fit != "no_fit" or judgment == "unsupported")
            and (treatment != "weak" or judgment != "supported")
        )
        if consistent:
            keep = "kept" if judgment == "supported" else "not_kept"
            worlds.append({"treatment": treatment, "fit": fit, "judgment": judgment, "keep": keep})
    return worlds


def world_patterns(spark: SparkSession, worlds: list[dict[str, str]] | None = None) -> DataFrame:
    """The consistent worlds of every pattern of known axes.

    A pattern has one entry per axis, ``?`` when unresolved; their number is
    the product of the axis sizes plus one, 240 for the default axes, whatever
    the size of the data. So the frame is safe to broadcast.
    """
    worlds = worlds or world_table()
    settled = F.array(*[
        F.struct(*[F.lit(w[a]).alias(a) for a in AXES]) for w in worlds
    ])
    patterns = spark.range(1)
    for axis in AXES:
        values = [UNKNOWN, *dict.fromkeys(w[axis] for w in worlds)]
        patterns = patterns.withColumn(f"p_{axis}", F.explode(F.array(*[F.lit(v) for v in values])))

    def agrees(w: Column) -> Column:
        ok = F.lit(True)
        for axis in AXES:
            ok = ok & ((F.col(f"p_{axis}") == UNKNOWN) | (w[axis] == F.col(f"p_{axis}")))
        return ok

    out = patterns.drop("id").withColumn("worlds", F.filter(settled, agrees))

    def values(axis: str) -> Column:
        return F.array_distinct(F.transform("worlds", lambda w: w[axis]))

    for axis in AXES:
        out = out.withColumn(f"v_{axis}", values(axis))
    return out.withColumn("n_worlds", F.size("worlds"))


def with_patterns(locators: DataFrame, columns: list[str]) -> DataFrame:
    """Locators with columns of their pattern row, by a broadcast equi join."""
    patterns = world_patterns(locators.sparkSession).select(*[f"p_{a}" for a in AXES], *columns)
    keyed = locators.withColumns({f"p_{a}": F.coalesce(a, F.lit(UNKNOWN)) for a in AXES})
    keys = [f"p_{a}" for a in AXES]
    joined = keyed.join(F.broadcast(patterns), keys, "left").drop(*keys)
    # A value outside the axis has no pattern and so no consistent world.
    nothing = F.array().cast("array<string>")
    return joined.withColumns({
        c: F.coalesce(c, nothing) for c in columns if c.startswith("v_")
    })


def to_percent(judgment: Column) -> Column:
    """Judgment 0-5 as a percentage in steps of 20."""
    return (judgment * 20).cast("decimal(5,2)")


def expand_locators(locators: DataFrame) -> DataFrame:
    """One row per page of a displayed locator range, with ``bad_range``.

    A range that ends before it begins, or lacks an end, is one row with a NULL
    page and ``bad_range`` true. Long ranges are expanded in blocks by many tasks.
    """
    bad = ~F.coalesce(F.col("page_from") <= F.col("page_to"), F.lit(False))
    marked = locators.withColumn("bad_range", bad)
    keys = locators.columns[:1]
    pages = explode_range(marked.filter(~F.col("bad_range")), keys, F.col("page_from"), F.col("page_to"), "page")
    return pages.unionByName(marked.filter("bad_range").withColumn("page", F.lit(None).cast("bigint")))


def locator_counts(locators: DataFrame, by: list[str]) -> DataFrame:
    """Displayed locators and page assignments, without expanding the ranges."""
    return locators.groupBy(*by).agg(
        F.count("*").alias("displayed_locators"),
        F.sum(F.greatest(F.lit(0), F.col("page_to") - F.col("page_from") + 1)).cast("bigint").alias("page_assignments"),
    )


def worlds(locators: DataFrame) -> DataFrame:
    """One row per locator and consistent world; the settled values as ``w_*``.

    An unavailable row has one world of its own, in which no other axis has a value.
    """
    own = F.array(F.struct(*[
        (F.lit(UNAVAILABLE) if a == "treatment" else F.lit(None).cast("string")).alias(a) for a in AXES
    ]))
    every = F.when(is_unavailable(), own).otherwise(F.col("worlds"))
    rows = with_patterns(locators, ["worlds"]).withColumn("w", F.explode(every)).drop("worlds")
    return rows.withColumns({f"w_{a}": F.col(f"w.{a}") for a in AXES}).drop("w")


def validate_axes(locators: DataFrame) -> DataFrame:
    """Axes recorded as unresolved although one value is forced, and empty world sets.

    ``problem`` is ``inconsistent`` or ``forced``; ``forced`` names the value.
    """
    rows = with_patterns(locators, ["n_worlds", *[f"v_{a}" for a in AXES]])
    forced = F.array_compact(F.array(*[
        F.when(
            F.col(a).isNull() & (F.size(f"v_{a}") == 1),
            F.struct(F.lit(a).alias("axis"), F.get(f"v_{a}", 0).alias("forced")),
        )
        for a in AXES
    ]))
    keys = ["candidate_id", "path_id", "locator_id"]
    inconsistent = (F.coalesce(F.col("n_worlds"), F.lit(0)) == 0) & ~is_unavailable()
    empty = F.array(F.struct(
        F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("forced")
    ))
    problems = F.when(inconsistent, empty).otherwise(forced)
    return rows.select(*keys, inconsistent.alias("_bad"), F.explode(problems).alias("p")).select(
        *keys, F.when(F.col("_bad"), "inconsistent").otherwise("forced").alias("problem"),
        "p.axis", "p.forced",
    )


def classify(rows: DataFrame) -> DataFrame:
    """``judgment_class`` of rows that carry ``v_judgment`` and ``v_keep``."""
    settled = (
        F.when(F.size("v_judgment") == 1, F.get("v_judgment", 0))
        .when(F.size("v_keep") > 1, "semantic_unresolved")
        .when(F.size("v_judgment") > 1, "not_kept_subtype_unresolved")
        .otherwise("inconsistent")
    )
    status = (
        F.when(F.col("inspected").isNull(), "not_measured")
        .when(~F.col("inspected") | is_unavailable(), "uninspectable").otherwise(settled)
    )
    return rows.withColumn("judgment_class", status)


def judgment_class(locators: DataFrame) -> DataFrame:
    """The judgment each row may carry, from its set of consistent worlds.

    One judgment left: that judgment. Several, none of them kept:
    ``not_kept_subtype_unresolved``. Kept and not kept: ``semantic_unresolved``.
    """
    return classify(with_patterns(locators, ["v_judgment", "v_keep"])).drop("v_judgment", "v_keep")


def grouped(rows: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """One aggregation for any set of named aggregates."""
    return rows.groupBy(*by).agg(*[c.alias(name) for name, c in aggs.items()])


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def keep_interval(classed: DataFrame) -> DataFrame:
    """Keep credit per row: kept 1, not kept 0, unresolved NULL between 0 and 1."""
    known = (
        F.when(F.col("judgment_class") == "supported", 1)
        .when(F.col("judgment_class").isin("partially_supported", "unsupported", "not_kept_subtype_unresolved"), 0)
    )
    return classed.withColumns({
        "keep_lo": F.coalesce(known, F.lit(0)), "keep_hi": F.coalesce(known, F.lit(1)), "keep_credit": known,
    })


def keep_aggregates() -> dict[str, Column]:
    """Sums over ``keep_interval`` rows."""
    return {
        "n_locators": F.count("*"), "n_resolved": F.count("keep_credit"),
        "_keep_lo": F.sum("keep_lo"), "_keep_hi": F.sum("keep_hi"),
        "_kept": F.coalesce(F.sum("keep_credit"), F.lit(0)),
    }


def keep_results() -> dict[str, Column]:
    n, resolved, kept = F.col("n_locators"), F.col("n_resolved"), F.col("_kept")
    return {
        "lower": ratio(F.col("_keep_lo"), n), "central": F.when(n == resolved, ratio(kept, n)),
        "upper": ratio(F.col("_keep_hi"), n), "resolved_only": ratio(kept, resolved),
    }


def keep_bounds(locators: DataFrame, by: list[str]) -> DataFrame:
    """Precision bounds on the original denominator.

    ``central`` exists only when no row is unresolved; ``resolved_only`` is the
    separately named rate among resolved rows.
    """
    sums = grouped(keep_interval(judgment_class(locators)), by, keep_aggregates())
    return sums.select(*by, "n_locators", "n_resolved", *_named(keep_results()))


def _credits(table: dict[str, int], values: Column) -> Column:
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(values, lambda v: lookup[v])


def axis_interval(rows: DataFrame, axis: str, credits: dict[str, int]) -> DataFrame:
    """``axis_lo`` and ``axis_hi``: least and greatest credit over the row's worlds."""
    found = _credits(credits, F.col(f"v_{axis}"))
    return rows.withColumns({"axis_lo": F.array_min(found), "axis_hi": F.array_max(found)})


def axis_aggregates() -> dict[str, Column]:
    """Sums over ``axis_interval`` rows."""
    return {
        "n_scored": F.count("axis_lo"), "n_inconsistent": F.count_if(F.col("axis_lo").isNull() & ~is_unavailable()),
        "n_unresolved": F.count_if(F.col("axis_lo") < F.col("axis_hi")),
        "credit_lower": F.sum("axis_lo").cast("bigint"), "credit_upper": F.sum("axis_hi").cast("bigint"),
    }


def axis_results() -> dict[str, Column]:
    return {
        "mean_lower": ratio(F.col("credit_lower"), F.col("n_scored")),
        "mean_upper": ratio(F.col("credit_upper"), F.col("n_scored")),
    }


def axis_bounds(locators: DataFrame, axis: str, credits: dict[str, int], by: list[str]) -> DataFrame:
    """Lower and upper mean credit of one axis over the consistent worlds.

    ``credits`` gives whole-number credits per axis value (a small policy
    input). Rows without a consistent world are counted apart.
    """
    rows = axis_interval(with_patterns(locators, [f"v_{axis}"]), axis, credits)
    return grouped(rows, by, axis_aggregates()).withColumns(axis_results())


def population_aggregates() -> dict[str, Column]:
    """Numbers of rows per state of ``judgment_class``."""
    state = F.col("judgment_class")
    return {
        "n_locators": F.count("*"),
        "resolved": F.count_if(state.isin(JUDGMENTS)),
        "subtype_unresolved": F.count_if(state == "not_kept_subtype_unresolved"),
        "semantic_unresolved": F.count_if(state == "semantic_unresolved"),
        "uninspectable": F.count_if(state == "uninspectable"),
        "not_measured": F.count_if(state == "not_measured"),
        "inconsistent": F.count_if(state == "inconsistent"),
    }


def population_counts(locators: DataFrame, by: list[str]) -> DataFrame:
    """Separate populations that add up to the original one."""
    total = F.expr(
        "resolved + subtype_unresolved + semantic_unresolved + uninspectable + not_measured + inconsistent"
    )
    out = grouped(judgment_class(locators), by, population_aggregates())
    return out.withColumn("preserved", total == F.col("n_locators"))


def selectivity_interval(rows: DataFrame, credits: dict[str, int]) -> DataFrame:
    """``sel_lo``, ``sel_hi`` and whether the row must or may be applicable."""
    applicable = F.filter("v_treatment", lambda v: v != "absent")
    level = _credits(credits, applicable)
    can = F.size(applicable) > 0
    must = can & (F.size(applicable) == F.size("v_treatment"))
    return rows.withColumns({
        "sel_lo": F.array_min(level), "sel_hi": F.array_max(level),
        "sel_none": (F.size("v_treatment") == 0) & ~is_unavailable(), "sel_must": must, "sel_may": can & ~must,
    })


def selectivity_aggregates(credits: dict[str, int]) -> dict[str, Column]:
    """Sums over ``selectivity_interval`` rows, optional rows by credit level."""
    must, may = F.col("sel_must"), F.col("sel_may")
    out = {
        "sel_inconsistent": F.count_if("sel_none"), "n_applicable": F.count_if(must), "n_optional": F.count_if(may),
        "_c_lo": F.coalesce(F.sum(F.when(must, F.col("sel_lo"))), F.lit(0)),
        "_c_hi": F.coalesce(F.sum(F.when(must, F.col("sel_hi"))), F.lit(0)),
    }
    for i, v in enumerate(sorted(set(credits.values()))):
        out[f"_lo_{i}"] = F.count_if(may & (F.col("sel_lo") == v))
        out[f"_hi_{i}"] = F.count_if(may & (F.col("sel_hi") == v))
    return out


def selectivity_results(credits: dict[str, int]) -> dict[str, Column]:
    """Bounds from every prefix of the credit levels; with no rows there is no ratio."""
    levels = sorted(set(credits.values()))

    def prefixes(base: str, stem: str, order: list[int]) -> list[Column]:
        total, count = F.col(base), F.col("n_applicable")
        out = [ratio(total, count)]
        for i in order:
            n = F.col(f"_{stem}_{i}")
            total, count = total + n * levels[i], count + n
            out.append(ratio(total, count))
        return out

    up = list(range(len(levels)))
    # least and greatest skip the NULL of an empty prefix.
    return {
        "selectivity_lower": F.least(*prefixes("_c_lo", "lo", up)),
        "selectivity_upper": F.greatest(*prefixes("_c_hi", "hi", up[::-1])),
    }


def selectivity_envelope(locators: DataFrame, credits: dict[str, int], by: list[str]) -> DataFrame:
    """Exact minimum and maximum of mean selectivity credit over the consistent worlds.

    ``credits`` covers the applicable treatments; ``absent`` rows are outside
    the denominator. A row that may or may not be applicable joins the mean
    only where that lowers (or raises) it. Optional rows of one credit behave
    alike, so it is enough to try every prefix of the few credit levels,
    lowest first for the minimum and highest first for the maximum.
    """
    rows = selectivity_interval(with_patterns(locators, ["v_treatment"]), credits)
    sums = grouped(rows, by, {"n_locators": F.count("*"), **selectivity_aggregates(credits)})
    lower, upper = F.col("selectivity_lower"), F.col("selectivity_upper")
    may_be_empty = F.col("n_applicable") == 0
    return sums.withColumns(selectivity_results(credits)).select(
        *by, "n_locators", F.col("sel_inconsistent").alias("n_inconsistent"), "n_applicable", "n_optional",
        lower.alias("lower"), upper.alias("upper"), may_be_empty.alias("may_be_empty"),
        F.when((lower == upper) & ~may_be_empty, lower).alias("central"),
    )


def unresolved_axes() -> Column:
    """Open axes of a classed row, NULL unless the row was inspected.

    ``keep`` is named only while the keep decision itself is open; a known
    non-keep with an open subtype names ``judgment``.
    """
    return F.when(F.col("inspected") & ~is_unavailable(), F.array_compact(F.array(
        F.when(F.col("treatment").isNull(), "treatment"),
        F.when(F.col("fit").isNull(), "fit"),
        F.when(F.col("judgment_class") == "not_kept_subtype_unresolved", "judgment"),
        F.when(F.col("judgment_class") == "semantic_unresolved", "keep"),
    )))


def blockers(locators: DataFrame) -> DataFrame:
    """One row per inspected locator with an unresolved axis, naming the axes."""
    classed = judgment_class(locators).withColumn("unresolved_axes", unresolved_axes())
    return classed.filter(F.size("unresolved_axes") > 0).select(
        "candidate_id", "path_id", "locator_id", "judgment_class", "unresolved_axes"
    )


def blocked_destinations(blocked: DataFrame, destinations: DataFrame) -> DataFrame:
    """Destinations that depend on an axis their locator leaves unresolved.

    ``destinations(candidate_id, path_id, locator_id, destination, needs_axis)``.
    """
    open_axes = blocked.select(
        "candidate_id", "path_id", "locator_id", F.explode("unresolved_axes").alias("needs_axis")
    )
    return destinations.join(
        open_axes, ["candidate_id", "path_id", "locator_id", "needs_axis"], "left_semi"
    )


def _gate_states(premises: dict[str, str]) -> tuple[Column, Column]:
    """Whether a row is evidence for a gate, and whether it still may be.

    Only an inspected row is evidence; a row not measured yet may become it, an
    uninspectable or unavailable one never.
    """
    there = ~is_unavailable()
    known = F.coalesce(F.col("inspected"), F.lit(False)) & there
    possible = F.coalesce(F.col("inspected"), F.lit(True)) & there
    for column, value in premises.items():
        equal = F.col(column) == F.lit(value)
        known = known & F.coalesce(equal, F.lit(False))
        possible = possible & F.coalesce(equal, F.lit(True))
    return known, possible


def gate_aggregates(rules: dict[str, dict]) -> dict[str, Column]:
    """Numbers of confirming and possible rows per gate, two columns each."""
    out = {}
    for gate, rule in rules.items():
        known, possible = _gate_states(rule["premises"])
        out[f"{gate}_confirmed"] = F.count_if(known)
        out[f"{gate}_possible"] = F.count_if(possible)
    return out


def gates(locators: DataFrame, rules: dict[str, dict], by: list[str]) -> DataFrame:
    """Gates per candidate from known premises only.

    ``rules`` maps a gate to ``{"premises": {column: value}, "at_least": n}``, a
    policy input of a dozen entries. An inspected row is evidence when every
    premise is known true; it is possible evidence when no premise is known
    false. Gates
    with no possible evidence have no row.
    """
    counted = grouped(locators, by, gate_aggregates(rules))
    rows = F.inline(F.array(*[
        F.struct(
            F.lit(gate).alias("gate"), F.col(f"{gate}_confirmed").alias("n_confirmed"),
            F.col(f"{gate}_possible").alias("n_possible"),
            (F.col(f"{gate}_confirmed") >= rule["at_least"]).alias("fires"),
            (F.col(f"{gate}_possible") >= rule["at_least"]).alias("may_fire"),
        )
        for gate, rule in rules.items()
    ]))
    return counted.select(*by, rows).filter("n_possible > 0")


def gate_evidence(locators: DataFrame, premises: dict[str, str]) -> DataFrame:
    """The locators that confirm one gate, one row each."""
    return locators.filter(_gate_states(premises)[0])


def authority(validity: Column, sufficient: Column) -> Column:
    return (
        F.when(validity == "invalid", "invalid")
        .when((validity == "valid") & F.coalesce(sufficient, F.lit(False)), "authoritative")
        .otherwise("indeterminate")
    )


def readiness(validity: Column, sufficient: Column, gated: Column) -> Column:
    return (
        F.when(F.coalesce(gated, F.lit(False)), "not_ready")
        .when((validity == "valid") & F.coalesce(sufficient, F.lit(False)), "ready")
        .otherwise("indeterminate")
    )


def sufficiency(blockers: Column, measured: Column, not_measured: Column, inconsistent: Column) -> Column:
    """Evidence suffices with some measured locator, none left to measure, none blocked or inconsistent."""
    zero = F.lit(0)
    return (
        (F.coalesce(measured, zero) > 0) & (F.coalesce(not_measured, zero) == 0)
        & (F.coalesce(blockers, zero) == 0) & (F.coalesce(inconsistent, zero) == 0)
    )


def evidenced_validity(validity: Column, uninspectable: Column) -> Column:
    """A valid candidate with locators nobody can inspect is indeterminate."""
    return F.when((validity == "valid") & (F.coalesce(uninspectable, F.lit(0)) > 0), "indeterminate").otherwise(validity)


def outcomes(candidates: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Machine outcomes by precedence, beside any human release decision.

    ``candidates(candidate_id, validity, sufficient, gated)`` with validity in
    valid, invalid, indeterminate; ``decisions(candidate_id, human_decision)``.
    The human column never changes a machine column.
    """
    v, s, g = F.col("validity"), F.col("sufficient"), F.col("gated")
    out = candidates.withColumns({"authority": authority(v, s), "readiness": readiness(v, s, g)})
    return out if decisions is None else out.join(decisions, "candidate_id", "left")


def routes_with_continuation(routes: DataFrame, continuations: DataFrame, keys: list[str]) -> DataFrame:
    """Routes plus the next page where an explicit continuation row allows it.

    ``routes(*keys, page)``; ``continuations(*keys, page)`` names the page that
    runs on. ``kind`` is ``direct`` or ``continued``.
    """
    onward = continuations.select(*keys, "page")
    continued = routes.join(onward, [*keys, "page"], "left_semi").withColumn("page", F.col("page") + 1)
    return routes.withColumn("kind", F.lit("direct")).unionByName(
        continued.withColumn("kind", F.lit("continued"))
    )


def treatment_recall(
    units: DataFrame, routes: DataFrame, candidates: DataFrame,
    match: list[str], scope: str = "source_id", cls: str = "locator_class",
) -> DataFrame:
    """Found units of all units per candidate and class.

    A unit is found when at least one valid route meets it on ``match`` (for
    instance source, subject and page); further facts and routes do not count
    twice. Totals join candidates by their scope, never each unit with each candidate.
    Both sides of the meeting are checkpointed, so that a unit many candidates
    route to can be split.
    """
    unit_rows = cut_lineage(units.select(*match, cls).distinct())
    totals = unit_rows.groupBy(scope, cls).agg(F.count("*").alias("n_units"))
    valid = cut_lineage(routes.filter("valid").select("candidate_id", *match).distinct())
    found = valid.join(unit_rows, match).groupBy("candidate_id", scope, cls).agg(F.count("*").alias("n_found"))
    board = candidates.select("candidate_id", scope).join(totals, scope)
    out = board.join(found, ["candidate_id", scope, cls], "left").withColumn(
        "n_found", F.coalesce("n_found", F.lit(0))
    )
    return out.withColumn("recall", ratio(F.col("n_found"), F.col("n_units")))


def parent_coverage(reqs: DataFrame, parent: list[str]) -> DataFrame:
    """``found``, ``partial``, ``missing`` or ``unresolved`` from requirement dispositions.

    ``reqs(*parent, disposition)`` with met, not_met or unresolved; an
    unresolved requirement keeps its parent unresolved unless part of it is
    met and part not.
    """
    n = {d: F.count_if(F.col("disposition") == d) for d in ("met", "not_met", "unresolved")}
    out = reqs.groupBy(*parent).agg(*[c.alias(f"n_{d}") for d, c in n.items()])
    status = (
        F.when(F.expr("n_met > 0 and n_not_met > 0"), "partial")
        .when(F.col("n_unresolved") > 0, "unresolved")
        .when(F.col("n_met") > 0, "found").otherwise("missing")
    )
    return out.withColumn("coverage", status)


def requirement_closure(
    inventory: DataFrame, receipts: DataFrame, keys: list[str], sha: str, position: str
) -> DataFrame:
    """Requirement keys with a conflict, without a receipt or without an inventory row.

    Identical repeats of a requirement are one obligation.
    """
    canonical = canonicalize(inventory, keys, sha, position)
    conflicts = canonical.filter("status = 'conflict'").select(*keys, F.lit("conflict").alias("problem"))
    gaps = closure(canonical.select(*keys), receipts, keys)
    return conflicts.unionByName(gaps.withColumnRenamed("kind", "problem"))


def score_units(parents: DataFrame, facets: DataFrame, keys: list[str]) -> DataFrame:
    """One scoring unit per parent; facets are counted beside it, never weighted."""
    counted = facets.groupBy(*keys).agg(F.count("*").alias("n_facets"))
    return parents.join(counted, keys, "left").withColumns({
        "n_facets": F.coalesce("n_facets", F.lit(0)), "units": F.lit(1).cast("bigint"),
    })


def stage_status(registrations: DataFrame, candidate: str, stages: list[str]) -> DataFrame:
    """Latest status per stage as one column per stage; ``not_started`` without a row.

    ``registrations(candidate, stage, status, recorded_at, seq)``; ``seq`` breaks ties.
    """
    latest = registrations.groupBy(candidate, "stage").agg(
        F.max_by("status", F.struct("recorded_at", "seq")).alias("status")
    )
    wide = latest.groupBy(candidate).pivot("stage", stages).agg(F.first("status"))
    return wide.fillna("not_started", stages)


def comparable(candidates: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """Candidates of the groups in which every shared field has one value."""
    same = F.lit(True)
    for c in shared:
        same = same & F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count("*"))
    groups = candidates.groupBy(*by).agg(same.alias("_same"), F.count("*").alias("_n")).filter("_same")
    return hot_join(candidates, groups.drop("_same"), by, "_n")


def compare_candidates(measures: DataFrame, by: list[str], candidate: str, names: list[str]) -> DataFrame:
    """Measures side by side, one column per candidate.

    ``measures(*by, candidate, value)`` in long form; ``names`` fixes the columns.
    """
    return measures.groupBy(*by).pivot(candidate, names).agg(F.max("value"))

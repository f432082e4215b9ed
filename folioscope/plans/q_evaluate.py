"""Queries: evaluation arithmetic over lines read as locators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.numbers import ratio
from folioscope.operators import evaluate
from folioscope.plans.evaluation import evaluate_candidates
from folioscope.plans.q_coverage import month_index
from folioscope.plans.registry import Tables, query

CANDIDATE = ["candidate_id"]

# The axes of a line. Known values follow the line's flags; some are left open,
# and some contradict each other on purpose.
AXES_SQL = {
    "treatment": """CASE WHEN l_orderkey % 53 = 0 THEN 'unavailable' WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'substantive' WHEN l_returnflag = 'N' THEN 'mixed'
                         WHEN l_partkey % 2 = 0 THEN 'weak' ELSE 'absent' END""",
    "fit": """CASE WHEN l_orderkey % 53 = 0 THEN CASE WHEN l_linenumber = 1 THEN 'exact_fit' END WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'exact_fit'
                   WHEN l_partkey % 3 = 0 THEN 'material_partial_fit' ELSE 'no_fit' END""",
    "judgment": """CASE WHEN l_orderkey % 53 = 0 OR l_orderkey % 3 = 0 THEN NULL WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 'partially_supported'
                        WHEN l_linestatus = 'F' THEN 'unsupported' WHEN l_returnflag = 'R' OR l_linenumber % 2 = 0 THEN 'partially_supported'
                        ELSE 'supported' END""",
    "keep": """CASE WHEN l_orderkey % 53 = 0 OR l_orderkey % 4 < 2 THEN NULL WHEN l_linestatus = 'F' OR l_returnflag = 'R' OR l_linenumber % 2 = 0 THEN 'not_kept'
                    ELSE 'kept' END""",
    "inspected": "CASE WHEN l_orderkey % 51 = 0 THEN NULL ELSE l_orderkey % 50 <> 0 END",
}


def locators(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("candidate_id"), F.col("l_orderkey").alias("path_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey").alias("locator_id"),
        *[F.expr(sql).alias(name) for name, sql in AXES_SQL.items()],
    )


LOCATORS_SQL = f"""
WITH loc AS (
  SELECT *, coalesce(treatment = 'unavailable' AND fit IS NULL AND judgment IS NULL AND keep IS NULL, false) AS una FROM (
    SELECT l_suppkey AS candidate_id, l_orderkey AS path_id, l_linenumber || '-' || l_partkey AS locator_id,
           {", ".join(f"{sql} AS {name}" for name, sql in AXES_SQL.items())} FROM lineitem)),
w AS (
  SELECT wt, wf, wj, CASE WHEN wj = 'supported' THEN 'kept' ELSE 'not_kept' END AS wk
  FROM (VALUES ('substantive'), ('mixed'), ('weak'), ('absent')) a(wt), (VALUES ('exact_fit'), ('material_partial_fit'), ('no_fit')) b(wf),
       (VALUES ('supported'), ('partially_supported'), ('unsupported')) c(wj)
  WHERE (wt <> 'absent' OR wf = 'no_fit') AND (wf <> 'material_partial_fit' OR wj = 'partially_supported')
    AND (wf <> 'no_fit' OR wj = 'unsupported') AND (wt <> 'weak' OR wj <> 'supported')),
pw AS (
  SELECT p.*, w.* FROM (SELECT DISTINCT treatment, fit, judgment, keep FROM loc) p LEFT JOIN w
    ON (treatment IS NULL OR treatment = wt) AND (fit IS NULL OR fit = wf) AND (judgment IS NULL OR judgment = wj) AND (keep IS NULL OR keep = wk)),
ps AS (
  SELECT treatment, fit, judgment, keep, count(wt) AS n_worlds, count(DISTINCT wt) AS nt, count(DISTINCT wf) AS nf, count(DISTINCT wj) AS nj, count(DISTINCT wk) AS nk,
         min(wt) AS mt, min(wf) AS mf, min(wj) AS mj, min(wk) AS mk,
         min(CASE wf WHEN 'exact_fit' THEN 2 WHEN 'material_partial_fit' THEN 1 WHEN 'no_fit' THEN 0 END) AS fit_lo,
         max(CASE wf WHEN 'exact_fit' THEN 2 WHEN 'material_partial_fit' THEN 1 WHEN 'no_fit' THEN 0 END) AS fit_hi,
         min(CASE wt WHEN 'substantive' THEN 4 WHEN 'mixed' THEN 2 WHEN 'weak' THEN 0 END) AS sel_lo,
         max(CASE wt WHEN 'substantive' THEN 4 WHEN 'mixed' THEN 2 WHEN 'weak' THEN 0 END) AS sel_hi,
         coalesce(bool_or(wt = 'absent'), false) AS can_be_absent
  FROM pw GROUP BY 1, 2, 3, 4),
c AS (
  SELECT loc.*, ps.* EXCLUDE (treatment, fit, judgment, keep),
         CASE WHEN inspected IS NULL THEN 'not_measured' WHEN NOT inspected OR una THEN 'uninspectable' WHEN nj = 1 THEN mj
              WHEN nk > 1 THEN 'semantic_unresolved' WHEN nj > 1 THEN 'not_kept_subtype_unresolved' ELSE 'inconsistent' END AS judgment_class
  FROM loc JOIN ps ON loc.treatment IS NOT DISTINCT FROM ps.treatment AND loc.fit IS NOT DISTINCT FROM ps.fit
    AND loc.judgment IS NOT DISTINCT FROM ps.judgment AND loc.keep IS NOT DISTINCT FROM ps.keep)
"""


def ratio_sql(num: str, den: str) -> str:
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    return f"CASE WHEN {d} = 0 THEN NULL ELSE CAST((2 * {n} * 1000000 + {d}) // (2 * {d}) / 1000000.0 AS DECIMAL(24,6)) END"


@query("SELECT p_partkey, CAST((p_size % 6) * 20 AS DECIMAL(5,2)) AS percent FROM part")
def percent_scale(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", evaluate.to_percent(F.col("p_size") % 6).alias("percent"))


@query("""
WITH r AS (SELECT l_suppkey, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INTEGER) % 4 - 1 AS b FROM lineitem)
SELECT l_suppkey, page, bad_range, count(*) AS n FROM (
  SELECT l_suppkey, CAST(unnest(range(a, b + 1)) AS BIGINT) AS page, false AS bad_range FROM r
  UNION ALL SELECT l_suppkey, NULL, true FROM r WHERE b < a) GROUP BY 1, 2, 3
""")
def locator_expand(t: Tables) -> DataFrame:
    """Displayed page ranges as single assignments, counted per supplier and page; some are reversed."""
    rows = evaluate.expand_locators(locator_ranges(t))
    return rows.groupBy("l_suppkey", "page", "bad_range").agg(F.count("*").alias("n"))


def locator_ranges(t: Tables) -> DataFrame:
    last = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4 - 1
    return t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("page_from"), last.alias("page_to"))


@query("""
SELECT l_suppkey, count(*) AS displayed_locators, CAST(sum(CAST(l_quantity AS INTEGER) % 4) AS BIGINT) AS page_assignments FROM lineitem GROUP BY 1
""")
def locator_counts(t: Tables) -> DataFrame:
    return evaluate.locator_counts(locator_ranges(t), ["l_suppkey"])


@query(LOCATORS_SQL + """
SELECT wt AS w_treatment, wf AS w_fit, wj AS w_judgment, wk AS w_keep, count(*) AS n FROM loc JOIN pw
  ON loc.treatment IS NOT DISTINCT FROM pw.treatment AND loc.fit IS NOT DISTINCT FROM pw.fit AND loc.judgment IS NOT DISTINCT FROM pw.judgment AND loc.keep IS NOT DISTINCT FROM pw.keep
WHERE wt IS NOT NULL GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'unavailable', NULL, NULL, NULL, count(*) FROM loc WHERE una HAVING count(*) > 0
""")
def axis_worlds(t: Tables) -> DataFrame:
    """How many locators admit each consistent world."""
    return evaluate.worlds(locators(t)).groupBy("w_treatment", "w_fit", "w_judgment", "w_keep").agg(
        F.count("*").alias("n")
    )


@query(LOCATORS_SQL + """
, v AS (
  SELECT candidate_id, 'inconsistent' AS problem, NULL AS axis, NULL AS forced FROM c WHERE n_worlds = 0 AND NOT una
  UNION ALL SELECT candidate_id, 'forced', 'treatment', mt FROM c WHERE treatment IS NULL AND nt = 1
  UNION ALL SELECT candidate_id, 'forced', 'fit', mf FROM c WHERE fit IS NULL AND nf = 1
  UNION ALL SELECT candidate_id, 'forced', 'judgment', mj FROM c WHERE judgment IS NULL AND nj = 1
  UNION ALL SELECT candidate_id, 'forced', 'keep', mk FROM c WHERE keep IS NULL AND nk = 1)
SELECT candidate_id, problem, axis, forced, count(*) AS n FROM v GROUP BY 1, 2, 3, 4
""")
def axis_validation(t: Tables) -> DataFrame:
    """Open axes that known facts already settle, and contradictions."""
    found = evaluate.validate_axes(locators(t))
    return found.groupBy("candidate_id", "problem", "axis", "forced").agg(F.count("*").alias("n"))


@query(LOCATORS_SQL + "SELECT candidate_id, judgment_class, count(*) AS n FROM c GROUP BY 1, 2")
def judgment_class(t: Tables) -> DataFrame:
    return evaluate.judgment_class(locators(t)).groupBy("candidate_id", "judgment_class").agg(F.count("*").alias("n"))


@query(LOCATORS_SQL + f"""
, k AS (SELECT candidate_id, CASE WHEN judgment_class = 'supported' THEN 1 WHEN judgment_class IN ('partially_supported', 'unsupported', 'not_kept_subtype_unresolved') THEN 0 END AS credit FROM c),
s AS (SELECT candidate_id, count(*) AS n, count(credit) AS r, coalesce(sum(credit), 0) AS kept, count(*) - count(credit) AS u FROM k GROUP BY 1)
SELECT candidate_id, n AS n_locators, r AS n_resolved, {ratio_sql("kept", "n")} AS lower, CASE WHEN n = r THEN {ratio_sql("kept", "n")} END AS central,
       {ratio_sql("kept + u", "n")} AS upper, {ratio_sql("kept", "r")} AS resolved_only FROM s
""")
def keep_bounds(t: Tables) -> DataFrame:
    return evaluate.keep_bounds(locators(t), CANDIDATE)


FIT_CREDITS = {"exact_fit": 2, "material_partial_fit": 1, "no_fit": 0}
SELECTIVITY_CREDITS = {"substantive": 4, "mixed": 2, "weak": 0}


@query(LOCATORS_SQL + f"""
, s AS (SELECT candidate_id, count(fit_lo) AS n, count(*) FILTER (fit_lo IS NULL AND NOT una) AS bad, count(*) FILTER (fit_lo < fit_hi) AS u, CAST(sum(fit_lo) AS BIGINT) AS lo, CAST(sum(fit_hi) AS BIGINT) AS hi FROM c GROUP BY 1)
SELECT candidate_id, n AS n_scored, bad AS n_inconsistent, u AS n_unresolved, lo AS credit_lower, hi AS credit_upper, {ratio_sql("lo", "n")} AS mean_lower, {ratio_sql("hi", "n")} AS mean_upper FROM s
""")
def axis_bounds(t: Tables) -> DataFrame:
    """Mean fit credit between its bounds; the credits are policy inputs."""
    return evaluate.axis_bounds(locators(t), "fit", FIT_CREDITS, CANDIDATE)


@query(LOCATORS_SQL + """
SELECT candidate_id, count(*) AS n_locators, count(*) FILTER (judgment_class IN ('supported', 'partially_supported', 'unsupported')) AS resolved,
       count(*) FILTER (judgment_class = 'not_kept_subtype_unresolved') AS subtype_unresolved, count(*) FILTER (judgment_class = 'semantic_unresolved') AS semantic_unresolved,
       count(*) FILTER (judgment_class = 'uninspectable') AS uninspectable, count(*) FILTER (judgment_class = 'not_measured') AS not_measured,
       count(*) FILTER (judgment_class = 'inconsistent') AS inconsistent, true AS preserved FROM c GROUP BY 1
""")
def population_counts(t: Tables) -> DataFrame:
    return evaluate.population_counts(locators(t), CANDIDATE)


@query(LOCATORS_SQL + f"""
, r AS (SELECT candidate_id, n_worlds = 0 AND NOT una AS bad, sel_lo IS NOT NULL AND NOT can_be_absent AS must, sel_lo IS NOT NULL AND can_be_absent AS may, sel_lo, sel_hi FROM c),
b AS (SELECT candidate_id, count(*) AS n, count(*) FILTER (bad) AS bad, count(*) FILTER (must) AS d, count(*) FILTER (may) AS o,
             coalesce(sum(sel_lo) FILTER (must), 0) AS c_lo, coalesce(sum(sel_hi) FILTER (must), 0) AS c_hi FROM r GROUP BY 1),
lv AS (SELECT candidate_id, 'lo' AS side, sel_lo AS credit, count(*) AS n FROM r WHERE may GROUP BY 1, 3 UNION ALL SELECT candidate_id, 'hi', sel_hi, count(*) FROM r WHERE may GROUP BY 1, 3),
cum AS (SELECT candidate_id, side, sum(credit * n) OVER w AS cc, sum(n) OVER w AS cn FROM lv
        WINDOW w AS (PARTITION BY candidate_id, side ORDER BY CASE WHEN side = 'lo' THEN credit ELSE -credit END)),
e AS (SELECT b.candidate_id, side, c_lo, c_hi, d, cc, cn FROM b JOIN cum USING (candidate_id)
      UNION ALL SELECT candidate_id, 'lo', c_lo, c_hi, d, 0, 0 FROM b UNION ALL SELECT candidate_id, 'hi', c_lo, c_hi, d, 0, 0 FROM b),
m AS (SELECT candidate_id, min({ratio_sql("c_lo + cc", "d + cn")}) FILTER (side = 'lo') AS lower, max({ratio_sql("c_hi + cc", "d + cn")}) FILTER (side = 'hi') AS upper FROM e GROUP BY 1)
SELECT candidate_id, n AS n_locators, bad AS n_inconsistent, d AS n_applicable, o AS n_optional, lower, upper, d = 0 AS may_be_empty,
       CASE WHEN lower = upper AND d <> 0 THEN lower END AS central FROM b JOIN m USING (candidate_id)
""")
def selectivity_envelope(t: Tables) -> DataFrame:
    """Exact bounds of mean selectivity while applicability itself is open."""
    return evaluate.selectivity_envelope(locators(t), SELECTIVITY_CREDITS, CANDIDATE)


BLOCKERS_SQL = LOCATORS_SQL + """
, bl AS (
  SELECT candidate_id, path_id, locator_id, judgment_class, list_filter([CASE WHEN treatment IS NULL THEN 'treatment' END, CASE WHEN fit IS NULL THEN 'fit' END,
         CASE WHEN judgment_class = 'not_kept_subtype_unresolved' THEN 'judgment' END, CASE WHEN judgment_class = 'semantic_unresolved' THEN 'keep' END], lambda x: x IS NOT NULL) AS axes
  FROM c WHERE inspected AND NOT una)
"""


@query(BLOCKERS_SQL + """
SELECT candidate_id, judgment_class, array_to_string(axes, ',') AS axes, count(*) AS n FROM bl WHERE len(axes) > 0 GROUP BY 1, 2, 3
""")
def blockers(t: Tables) -> DataFrame:
    found = evaluate.blockers(locators(t)).withColumn("axes", F.array_join("unresolved_axes", ","))
    return found.groupBy("candidate_id", "judgment_class", "axes").agg(F.count("*").alias("n"))


@query(BLOCKERS_SQL + """
SELECT candidate_id, needs_axis, count(*) AS n_blocked FROM (
  SELECT candidate_id, axes, CASE WHEN path_id % 2 = 0 THEN 'fit' ELSE 'treatment' END AS needs_axis FROM bl) WHERE list_contains(axes, needs_axis) GROUP BY 1, 2
""")
def blocked_destinations(t: Tables) -> DataFrame:
    """Each locator has one destination that depends on one of its axes."""
    rows = locators(t)
    destinations = rows.select(
        "candidate_id", "path_id", "locator_id", F.lit("d").alias("destination"),
        F.when(F.col("path_id") % 2 == 0, "fit").otherwise("treatment").alias("needs_axis"),
    )
    found = evaluate.blocked_destinations(evaluate.blockers(rows), destinations)
    return found.groupBy("candidate_id", "needs_axis").agg(F.count("*").alias("n_blocked"))


# Premises and thresholds are inputs of the evaluated policy; these are samples.
GATE_RULES = {
    "wrong_locator": {"premises": {"treatment": "absent", "fit": "no_fit", "keep": "not_kept"}, "at_least": 20},
    "systemic_unsupported_content": {"premises": {"judgment": "unsupported"}, "at_least": 140},
    "scope_locator": {"premises": {"treatment": "absent", "judgment": "unsupported"}, "at_least": 30},
}


def gate_sql() -> str:
    parts = []
    for gate, rule in GATE_RULES.items():
        known = "coalesce(inspected, false) AND NOT una AND " + " AND ".join(f"coalesce({c} = '{v}', false)" for c, v in rule["premises"].items())
        possible = "coalesce(inspected, true) AND NOT una AND " + " AND ".join(f"coalesce({c} = '{v}', true)" for c, v in rule["premises"].items())
        parts.append(
            f"SELECT candidate_id, '{gate}' AS gate, {rule['at_least']} AS at_least, count(*) FILTER ({known}) AS n_confirmed, "
            f"count(*) FILTER ({possible}) AS n_possible FROM loc GROUP BY 1"
        )
    return " UNION ALL ".join(parts)


GATES_SQL = LOCATORS_SQL + f", g AS (SELECT * FROM ({gate_sql()}) WHERE n_possible > 0)"


@query(GATES_SQL + """
SELECT candidate_id, gate, n_confirmed, n_possible, n_confirmed >= at_least AS fires, n_possible >= at_least AS may_fire FROM g
""")
def gates(t: Tables) -> DataFrame:
    return evaluate.gates(locators(t), GATE_RULES, CANDIDATE)


@query(LOCATORS_SQL + """
SELECT candidate_id, path_id, locator_id FROM loc WHERE inspected AND treatment = 'absent' AND fit = 'no_fit' AND keep = 'not_kept'
""")
def gate_evidence(t: Tables) -> DataFrame:
    found = evaluate.gate_evidence(locators(t), GATE_RULES["wrong_locator"]["premises"])
    return found.select("candidate_id", "path_id", "locator_id")


@query(GATES_SQL + """
, bl AS (SELECT candidate_id, count(*) AS n FROM c WHERE inspected AND NOT una AND (treatment IS NULL OR fit IS NULL OR judgment_class IN ('not_kept_subtype_unresolved', 'semantic_unresolved')) GROUP BY 1),
n AS (SELECT candidate_id, count(*) AS n FROM loc GROUP BY 1),
f AS (SELECT candidate_id, bool_or(n_confirmed >= at_least) AS gated FROM g GROUP BY 1),
s AS (SELECT s_suppkey AS candidate_id, CASE WHEN s_suppkey % 10 = 0 THEN 'invalid' WHEN s_suppkey % 10 = 1 THEN 'indeterminate' ELSE 'valid' END AS validity,
             coalesce(coalesce(bl.n, 0) * 100 < n.n * 36, false) AS sufficient, coalesce(gated, false) AS gated, CASE WHEN s_suppkey % 4 = 0 THEN 'approved_with_deviation' END AS human_decision
      FROM supplier LEFT JOIN bl ON s_suppkey = bl.candidate_id LEFT JOIN n ON s_suppkey = n.candidate_id LEFT JOIN f ON s_suppkey = f.candidate_id)
SELECT *, CASE WHEN validity = 'invalid' THEN 'invalid' WHEN validity = 'valid' AND sufficient THEN 'authoritative' ELSE 'indeterminate' END AS authority,
       CASE WHEN gated THEN 'not_ready' WHEN validity = 'valid' AND sufficient THEN 'ready' ELSE 'indeterminate' END AS readiness FROM s
""")
def outcomes(t: Tables) -> DataFrame:
    """Suppliers as candidates: gates, blockers and validity decide, a human decision stands beside."""
    rows = locators(t)
    blocked = evaluate.blockers(rows).groupBy("candidate_id").agg(F.count("*").alias("n"))
    total = rows.groupBy("candidate_id").agg(F.count("*").alias("n_locators"))
    gated = evaluate.gates(rows, GATE_RULES, CANDIDATE).groupBy("candidate_id").agg(F.bool_or("fires").alias("gated"))
    key = F.col("s_suppkey")
    validity = F.when(key % 10 == 0, "invalid").when(key % 10 == 1, "indeterminate").otherwise("valid")
    board = (
        t.supplier.select(key.alias("candidate_id"), validity.alias("validity"))
        .join(blocked, "candidate_id", "left").join(total, "candidate_id", "left").join(gated, "candidate_id", "left")
        .select(
            "candidate_id", "validity",
            # Blockers on fewer than 36 of 100 locators; without locators nothing suffices.
            F.coalesce(F.coalesce("n", F.lit(0)) * 100 < F.col("n_locators") * 36, F.lit(False)).alias("sufficient"),
            F.coalesce("gated", F.lit(False)).alias("gated"),
        )
    )
    decisions = t.supplier.filter(key % 4 == 0).select(
        key.alias("candidate_id"), F.lit("approved_with_deviation").alias("human_decision")
    )
    return evaluate.outcomes(board, decisions)


@query("""
WITH r AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page, l_linenumber FROM lineitem),
k AS (SELECT DISTINCT l_suppkey, page FROM r WHERE l_linenumber = 7)
SELECT kind, page, count(*) AS n FROM (SELECT 'direct' AS kind, page FROM r UNION ALL SELECT 'continued', page + 1 FROM r SEMI JOIN k USING (l_suppkey, page)) GROUP BY 1, 2
""")
def routes_with_continuation(t: Tables) -> DataFrame:
    """A route reaches the next page only where a continuation is on record."""
    routes = t.lineitem.select("l_suppkey", month_index(F.col("l_shipdate")).alias("page"), "l_linenumber")
    found = evaluate.routes_with_continuation(
        routes.drop("l_linenumber"), routes.filter("l_linenumber = 7"), ["l_suppkey"]
    )
    return found.groupBy("kind", "page").agg(F.count("*").alias("n"))


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderpriority AS source_id, o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS page, o_orderstatus AS locator_class FROM orders),
u AS (SELECT DISTINCT source_id, o_custkey, page, locator_class FROM o),
r AS (SELECT DISTINCT l_returnflag AS candidate_id, source_id, o_custkey, year(l_shipdate) * 12 + month(l_shipdate) AS page FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_linenumber <> 3),
k AS (SELECT DISTINCT l_returnflag AS candidate_id, source_id FROM lineitem JOIN o ON l_orderkey = o_orderkey),
n AS (SELECT source_id, locator_class, count(*) AS n_units FROM u GROUP BY 1, 2),
fs AS (SELECT candidate_id, source_id, locator_class, count(*) AS n_found FROM r JOIN u USING (source_id, o_custkey, page) GROUP BY 1, 2, 3)
SELECT candidate_id, source_id, locator_class, n_units, coalesce(n_found, 0) AS n_found, {ratio_sql("coalesce(n_found, 0)", "n_units")} AS recall
FROM k JOIN n USING (source_id) LEFT JOIN fs USING (candidate_id, source_id, locator_class)
""")
def treatment_recall(t: Tables) -> DataFrame:
    """Customers' order months as units, shipments as routes, return flags as candidates."""
    orders = t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("source_id"), "o_custkey",
        month_index(F.col("o_orderdate")).alias("page"), F.col("o_orderstatus").alias("locator_class"),
    )
    routes = t.lineitem.join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "source_id", "o_custkey"), "l_orderkey"
    ).select(
        F.col("l_returnflag").alias("candidate_id"), "source_id", "o_custkey",
        month_index(F.col("l_shipdate")).alias("page"), (F.col("l_linenumber") != 3).alias("valid"),
    )
    candidates = routes.select("candidate_id", "source_id").distinct()
    return evaluate.treatment_recall(orders, routes, candidates, ["source_id", "o_custkey", "page"])


@query("""
SELECT *, CASE WHEN n_met > 0 AND n_not_met > 0 THEN 'partial' WHEN n_unresolved > 0 THEN 'unresolved' WHEN n_met > 0 THEN 'found' ELSE 'missing' END AS coverage
FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_met, count(*) FILTER (l_returnflag = 'N') AS n_not_met, count(*) FILTER (l_returnflag = 'R') AS n_unresolved FROM lineitem GROUP BY 1)
""")
def parent_coverage(t: Tables) -> DataFrame:
    """Orders as parents, lines as requirements."""
    flag = F.col("l_returnflag")
    reqs = t.lineitem.select(
        "l_orderkey", F.when(flag == "A", "met").when(flag == "N", "not_met").otherwise("unresolved").alias("disposition")
    )
    return evaluate.parent_coverage(reqs, ["l_orderkey"])


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' UNION SELECT o_orderkey, 9 FROM orders WHERE o_orderkey % 10 = 0)
SELECT problem, l_linenumber, count(*) AS n FROM (
  SELECT 'conflict' AS problem, l_linenumber FROM i WHERE v > 1
  UNION ALL SELECT 'missing', l_linenumber FROM i ANTI JOIN r USING (l_orderkey, l_linenumber)
  UNION ALL SELECT 'extra', l_linenumber FROM r ANTI JOIN i USING (l_orderkey, l_linenumber)) GROUP BY 1, 2
""")
def requirement_closure(t: Tables) -> DataFrame:
    """Line numbers as requirements of an order; receipts cover the open lines only."""
    keys = ["l_orderkey", "l_linenumber"]
    inventory = t.lineitem.select(*keys, F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha"), "l_suppkey")
    receipts = t.lineitem.filter("l_linestatus = 'O'").select(*keys).unionByName(
        t.orders.filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(9).alias("l_linenumber"))
    )
    found = evaluate.requirement_closure(inventory, receipts, keys, "sha", "l_suppkey")
    return found.groupBy("problem", "l_linenumber").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_facets, CAST(1 AS BIGINT) AS units FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def score_units(t: Tables) -> DataFrame:
    parents = t.orders.select("o_orderkey")
    return evaluate.score_units(parents, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("""
WITH l AS (SELECT user_id, event_type, max_by('s' || (event_id % 4), (ts, event_id)) AS status FROM events GROUP BY 1, 2)
SELECT user_id, coalesce(max(status) FILTER (event_type = 'signup'), 'not_started') AS signup, coalesce(max(status) FILTER (event_type = 'view'), 'not_started') AS view,
       coalesce(max(status) FILTER (event_type = 'purchase'), 'not_started') AS purchase, 'not_started' AS report FROM l GROUP BY 1
""")
def stage_status(t: Tables) -> DataFrame:
    """Latest status of each stage per user; one stage never happened."""
    rows = t.events.select(
        "user_id", F.col("event_type").alias("stage"), F.concat(F.lit("s"), F.col("event_id") % 4).alias("status"),
        F.col("ts").alias("recorded_at"), F.col("event_id").alias("seq"),
    )
    return evaluate.stage_status(rows, "user_id", ["signup", "view", "purchase", "report"])


@query("""
SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 2) = 1)
""")
def comparable(t: Tables) -> DataFrame:
    """Suppliers whose nation agrees on one lock value."""
    candidates = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 2).alias("lock"))
    return evaluate.comparable(candidates, ["s_nationkey"], ["lock"]).drop("lock")


@query(LOCATORS_SQL + f"""
, m AS (SELECT l_returnflag AS f, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS kept, count(DISTINCT l_orderkey) AS paths FROM lineitem GROUP BY 1),
v AS (SELECT 'locators' AS measure, f, CAST(n AS DECIMAL(24,6)) AS value FROM m UNION ALL SELECT 'paths', f, CAST(paths AS DECIMAL(24,6)) FROM m
      UNION ALL SELECT 'open_share', f, {ratio_sql("kept", "n")} FROM m)
SELECT measure, max(value) FILTER (f = 'A') AS A, max(value) FILTER (f = 'N') AS N, max(value) FILTER (f = 'R') AS R FROM v GROUP BY 1
""")
def comparison(t: Tables) -> DataFrame:
    """Three candidates side by side."""
    per = t.lineitem.groupBy("l_returnflag", "l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("kept")
    ).groupBy("l_returnflag").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("kept").cast("bigint").alias("kept"), F.count("*").alias("paths")
    )
    value = lambda c: c.cast("decimal(24,6)").alias("value")
    measures = per.select("l_returnflag", F.inline(F.array(
        F.struct(F.lit("locators").alias("measure"), value(F.col("n"))),
        F.struct(F.lit("paths").alias("measure"), value(F.col("paths"))),
        F.struct(F.lit("open_share").alias("measure"), value(ratio(F.col("kept"), F.col("n")))),
    )))
    return evaluate.compare_candidates(measures, ["measure"], "l_returnflag", ["A", "N", "R"])


@query(BLOCKERS_SQL + f"""
, k AS (SELECT candidate_id, count(*) AS n, CAST(count(*) FILTER (judgment_class = 'supported') AS BIGINT) AS kept,
               count(*) FILTER (judgment_class IN ('semantic_unresolved', 'uninspectable', 'not_measured', 'inconsistent')) AS u,
               count(fit_lo) AS f, CAST(sum(fit_lo) AS BIGINT) AS flo, CAST(sum(fit_hi) AS BIGINT) AS fhi,
               count(*) FILTER (judgment_class IN ('inconsistent', 'not_measured', 'uninspectable')) AS bad FROM c GROUP BY 1),
b AS (SELECT candidate_id, count(*) AS nb FROM bl WHERE len(axes) > 0 GROUP BY 1),
g AS (SELECT candidate_id, bool_or(n_confirmed >= at_least) AS gated FROM ({gate_sql()}) GROUP BY 1)
SELECT s_suppkey AS candidate_id, {ratio_sql("kept", "n")} AS precision_lower, {ratio_sql("kept + u", "n")} AS precision_upper, {ratio_sql("flo", "f")} AS fit_lower, {ratio_sql("fhi", "f")} AS fit_upper,
       coalesce(nb, 0) AS n_blockers, CASE WHEN gated THEN 'not_ready' WHEN coalesce(nb, 0) = 0 AND bad = 0 THEN 'ready' ELSE 'indeterminate' END AS readiness
FROM supplier LEFT JOIN k ON s_suppkey = k.candidate_id LEFT JOIN b USING (candidate_id) LEFT JOIN g USING (candidate_id)
""")
def evaluation_board(t: Tables) -> DataFrame:
    """The whole evaluation job over every supplier, those without lines too."""
    rows = locators(t)
    candidates = t.supplier.select(F.col("s_suppkey").alias("candidate_id"), F.lit("valid").alias("validity"))
    board = evaluate_candidates(rows, candidates, GATE_RULES, FIT_CREDITS, SELECTIVITY_CREDITS)
    return board.select(
        "candidate_id", "precision_lower", "precision_upper", "fit_lower", "fit_upper", "n_blockers", "readiness"
    )

"""Queries: version diffs, patches, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.canonical import record_sha
from folioscope.operators import diff, identity
from folioscope.plans.q_identity import CHANGED_SQL, CUSTOMER_FIELDS, changed_customers
from folioscope.plans.registry import Tables, query

KEY = ["c_custkey"]
FIELDS = ["c_mktsegment", "c_name", "c_nationkey"]


def sealed(df: DataFrame) -> DataFrame:
    return df.withColumn("sha", record_sha(CUSTOMER_FIELDS))


STATUS_SQL = """CASE WHEN v1.c_custkey IS NULL THEN 'added' WHEN v2.c_custkey IS NULL THEN 'removed'
  WHEN v1.c_nationkey = v2.c_nationkey AND v1.c_mktsegment = v2.c_mktsegment THEN 'unchanged' ELSE 'updated' END"""


@query(CHANGED_SQL + f"""
SELECT coalesce(v1.c_custkey, v2.c_custkey) AS c_custkey, {STATUS_SQL} AS status FROM v1 FULL JOIN v2 ON v1.c_custkey = v2.c_custkey
""")
def diff_records(t: Tables) -> DataFrame:
    old, new = (sealed(d) for d in changed_customers(t))
    return diff.diff_records(old, new, KEY, "sha").select("c_custkey", "status")


CHANGED_FIELDS_SQL = CHANGED_SQL + """,
changed AS (
  SELECT c_custkey, list_filter([CASE WHEN v1.c_mktsegment <> v2.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN v1.c_nationkey <> v2.c_nationkey THEN 'c_nationkey' END], lambda x: x IS NOT NULL) AS fields
  FROM v1 JOIN v2 USING (c_custkey) WHERE v1.c_mktsegment <> v2.c_mktsegment OR v1.c_nationkey <> v2.c_nationkey)
"""


@query(CHANGED_FIELDS_SQL + "SELECT c_custkey, array_to_string(fields, ',') AS fields FROM changed")
def changed_fields(t: Tables) -> DataFrame:
    found = diff.changed_fields(*changed_customers(t), KEY, FIELDS)
    return found.withColumn("fields", F.array_join("fields", ","))


def nested_json(df: DataFrame) -> DataFrame:
    doc = F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("place"),
        F.array(F.col("c_mktsegment"), F.concat(F.lit("t"), F.col("c_custkey") % 3)).alias("tags"),
    )
    return df.select("c_custkey", F.to_json(doc).alias("json"))


def nested_leaves(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(diff.flatten_json(nested_json(d), KEY, "json") for d in changed_customers(t))


LEAVES_SQL = CHANGED_SQL + """,
l1 AS (SELECT c_custkey, unnest(['/name', '/place/nation', '/tags/0', '/tags/1']) AS pointer,
              unnest(['"' || c_name || '"', CAST(c_nationkey AS VARCHAR), '"' || c_mktsegment || '"', '"t' || (c_custkey % 3) || '"']) AS value FROM v1),
l2 AS (SELECT c_custkey, unnest(['/name', '/place/nation', '/tags/0', '/tags/1']) AS pointer,
              unnest(['"' || c_name || '"', CAST(c_nationkey AS VARCHAR), '"' || c_mktsegment || '"', '"t' || (c_custkey % 3) || '"']) AS value FROM v2),
d AS (SELECT c_custkey, pointer, CASE WHEN l1.value IS NULL THEN 'add' WHEN l2.value IS NULL THEN 'remove' ELSE 'replace' END AS op, l1.value AS before, l2.value AS after
      FROM l1 FULL JOIN l2 USING (c_custkey, pointer) WHERE l1.value IS DISTINCT FROM l2.value)
"""


@query(LEAVES_SQL + "SELECT * FROM d")
def field_diff_long(t: Tables) -> DataFrame:
    """Leaf changes of nested documents as pointers with before and after."""
    return diff.diff_fields(*nested_leaves(t), KEY)


@query(LEAVES_SQL + """
SELECT c_custkey, pointer, CASE WHEN c_custkey % 3 = 0 THEN 'before_differs' ELSE 'result_differs' END AS problem FROM d
WHERE c_custkey % 100 = 0 AND op <> 'add' AND (op = 'replace' OR c_custkey % 3 = 0)
UNION ALL SELECT c_custkey, pointer, 'result_differs' FROM d WHERE c_custkey % 100 = 0 AND c_custkey % 3 <> 0 AND op = 'remove'
UNION ALL SELECT c_custkey, pointer, CASE WHEN c_custkey % 3 = 0 THEN 'before_differs' ELSE 'result_differs' END FROM d WHERE c_custkey % 100 = 0 AND op = 'add'
""")
def roundtrip(t: Tables) -> DataFrame:
    """Before + diff gives the proposal, except where the diff was tampered with."""
    old, new = nested_leaves(t)
    changes = diff.diff_fields(old, new, KEY)
    hit = F.col("c_custkey") % 100 == 0
    tampered = changes.withColumns({
        "before": F.when(hit & (F.col("c_custkey") % 3 == 0), F.lit('"other"')).otherwise(F.col("before")),
        "after": F.when(hit & (F.col("c_custkey") % 3 != 0), F.lit('"other"')).otherwise(F.col("after")),
    })
    return diff.roundtrip(old, tampered, new, KEY)


def part_patches(t: Tables) -> DataFrame:
    """Three components: later ones win where they meet an earlier one."""
    base = t.part.select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    one = base.filter(key % 3 == 0).withColumn("p_size", F.col("p_size") + 100)
    two = base.filter(key % 5 == 0).withColumn("p_name", F.lit("second"))
    three = base.filter(key % 7 == 0)
    new = base.filter(key % 20 == 0).withColumn("p_partkey", -1 - key)

    def part(df: DataFrame, seq: int, action: str = "put") -> DataFrame:
        return df.withColumns({"action": F.lit(action), "seq": F.lit(seq), "component": F.lit(f"C{seq}")})

    return part(one, 1).unionByName(part(two, 2)).unionByName(part(three, 3, "remove")).unionByName(part(new, 3))


PATCH_SQL = """
WITH composed AS (
  SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'second' ELSE p_name END AS p_name,
         CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT -1 - p_partkey, p_name, p_size FROM part WHERE p_partkey % 20 = 0)
"""


@query(PATCH_SQL + "SELECT * FROM composed")
def compose_patches(t: Tables) -> DataFrame:
    return diff.compose(t.part.select("p_partkey", "p_name", "p_size"), part_patches(t), ["p_partkey"])


@query("""
SELECT p_partkey, p_name, p_size + 100 AS p_size FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 1
UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1
""")
def apply_patch(t: Tables) -> DataFrame:
    """One patch of replacements and removals; a removal comes alone for its key."""
    base = t.part.select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    put = base.filter((key % 3 == 0) & (key % 4 != 1)).withColumn("p_size", F.col("p_size") + 100)
    gone = base.filter(key % 4 == 1)
    patch = put.withColumn("action", F.lit("put")).unionByName(gone.withColumn("action", F.lit("remove")))
    return diff.apply_patch(base, patch, ["p_partkey"])


@query("""
SELECT p_partkey, n AS n_components FROM (
  SELECT p_partkey, CAST(p_partkey % 3 = 0 AS BIGINT) + CAST(p_partkey % 5 = 0 AS BIGINT) + CAST(p_partkey % 7 = 0 AS BIGINT) AS n FROM part) WHERE n > 1
""")
def patch_overlaps(t: Tables) -> DataFrame:
    return diff.patch_overlaps(part_patches(t), ["p_partkey"], "component")


OVERLAP_SQL = """
WITH ch AS (
  SELECT p_partkey, 'A' AS component, '/name' AS pointer, p_name AS value FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 'B', '/name', 'from B' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'B', '/size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 0
  -- C removes some names: a removal disputes a value and can win
  UNION ALL SELECT p_partkey, 'C', '/name', NULL FROM part WHERE p_partkey % 5 = 0),
r AS (
  SELECT p_partkey, 'B' AS component FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 'C' FROM part WHERE p_partkey % 25 = 0),
j AS (
  SELECT p_partkey, pointer, count(DISTINCT coalesce('v' || value, 'removed')) AS n, max(value) AS v,
         count(*) FILTER (pointer = '/name' AND component = (SELECT max(component) FROM r WHERE r.p_partkey = ch.p_partkey)) AS ruled,
         max(value) FILTER (pointer = '/name' AND component = (SELECT max(component) FROM r WHERE r.p_partkey = ch.p_partkey)) AS w,
         pointer = '/name' AND (SELECT count(*) FROM r WHERE r.p_partkey = ch.p_partkey) > 1 AS two
  FROM ch GROUP BY 1, 2)
SELECT p_partkey, pointer, CASE WHEN two THEN NULL WHEN ruled > 0 THEN w WHEN n = 1 THEN v END AS value,
       two OR (ruled = 0 AND n > 1) AS unresolved FROM j
"""


@query(OVERLAP_SQL)
def resolve_overlap(t: Tables) -> DataFrame:
    """Three components change names, one by removal; rules name winners, twice two of them."""
    key = F.col("p_partkey")
    def change(cond, component: str, pointer: str, value) -> DataFrame:
        return t.part.filter(cond).select(
            "p_partkey", F.lit(component).alias("component"), F.lit(pointer).alias("pointer"), value.cast("string").alias("value")
        )

    changes = (
        change(key % 2 == 0, "A", "/name", F.col("p_name"))
        .unionByName(change(key % 3 == 0, "B", "/name", F.lit("from B")))
        .unionByName(change(key % 3 == 0, "B", "/size", F.col("p_size")))
        .unionByName(change(key % 5 == 0, "C", "/name", F.lit(None)))
    )
    def rule(cond, component: str) -> DataFrame:
        return t.part.filter(cond).select("p_partkey", F.lit("/name").alias("pointer"), F.lit(component).alias("component"))

    rules = rule(key % 4 == 0, "B").unionByName(rule(key % 25 == 0, "C"))
    resolved, unresolved = diff.resolve_overlap(changes, rules, ["p_partkey"])
    return resolved.withColumn("unresolved", F.lit(False)).unionByName(
        unresolved.select("p_partkey", "pointer", F.lit(None).cast("string").alias("value"), F.lit(True).alias("unresolved"))
    )


@query("SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 9 <> 0 AS valid FROM customer WHERE c_custkey % 3 = 0")
def guard_before(t: Tables) -> DataFrame:
    """Patches against a recorded digest; some digests are stale, some patches claim a new key."""
    base = sealed(t.customer.select(*CUSTOMER_FIELDS))
    key = F.col("c_custkey")
    patch = base.filter(key % 3 == 0).select(
        "c_custkey", F.when(key % 9 == 0, F.lit(None)).when(key % 4 == 0, F.lit("stale")).otherwise(F.col("sha")).alias("before_sha")
    )
    return diff.guard_before(base, patch, KEY, "sha").select("c_custkey", "valid")


@query(CHANGED_FIELDS_SQL + """
SELECT c_custkey, 'update' AS action, field FROM (SELECT c_custkey, unnest(fields) AS field FROM changed)
WHERE NOT (field = 'c_nationkey' AND c_custkey % 2 = 0) AND NOT (field = 'c_mktsegment' AND c_custkey % 3 = 0)
""")
def unapproved_changes(t: Tables) -> DataFrame:
    """Changed fields against a ledger that approves some of them."""
    changes = diff.changed_fields(*changed_customers(t), KEY, FIELDS).withColumn("action", F.lit("update"))
    key = F.col("c_custkey")
    approved = t.customer.select("c_custkey", F.lit("update").alias("action"), F.explode(F.array_compact(F.array(
        F.when(key % 2 == 0, "c_nationkey"), F.when(key % 3 == 0, "c_mktsegment")
    ))).alias("field"))
    return diff.unapproved(changes, approved, KEY)


@query("""
WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
a AS (SELECT l_orderkey, l_partkey FROM b WHERE l_partkey % 10 <> 0 UNION SELECT l_orderkey, -1 - l_partkey FROM b WHERE l_partkey % 40 = 1)
SELECT l_orderkey, l_partkey, 'lost' AS problem FROM b WHERE l_partkey % 10 = 0 AND l_partkey % 30 <> 0
UNION ALL SELECT l_orderkey, l_partkey, 'unnamed_addition' FROM a WHERE l_partkey < 0 AND l_partkey % 3 <> 0
""")
def preserved_children(t: Tables) -> DataFrame:
    """Lines of an order lost and gained, some of them declared."""
    keys = ["l_orderkey", "l_partkey"]
    before = t.lineitem.select(*keys).distinct()
    part = F.col("l_partkey")
    gained = before.filter(part % 40 == 1).withColumn("l_partkey", -1 - part)
    after = before.filter(part % 10 != 0).unionByName(gained)
    return diff.preserved_children(
        before, after, keys, before.filter(part % 30 == 0), gained.filter(part % 3 == 0)
    )


@query("""
WITH ch AS (SELECT p_partkey AS s FROM part WHERE p_size = 7),
e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
tk AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT s FROM ch))
SELECT 'relationships' AS kind, count(*) AS n FROM e WHERE a IN (SELECT s FROM ch) OR b IN (SELECT s FROM ch)
UNION ALL SELECT 'tasks', count(*) FROM tk
UNION ALL SELECT 'facets', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT s FROM ch))
UNION ALL SELECT 'orders', count(DISTINCT o_custkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM tk)
""")
def dependency_closure(t: Tables) -> DataFrame:
    """Changed parts reach their edges, orders (tasks), order lines (facets) and customers."""
    changed = t.part.filter("p_size = 7").select(F.col("p_partkey").alias("subject_id"))
    edges = t.lineitem.select(
        F.col("l_partkey").alias("source_subject_id"), F.col("l_suppkey").alias("target_subject_id")
    ).distinct()
    facets = t.lineitem.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("facet_id"), F.col("l_partkey").alias("subject_id")
    )
    found = diff.dependency_closure(changed, edges, facets.drop("facet_id"), facets)
    customers = t.orders.join(found["tasks"], F.col("o_orderkey") == F.col("task_id"), "left_semi").select("o_custkey").distinct()
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in (*found.items(), ("orders", customers))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("""
SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page, l_returnflag, count(*) AS n_evidence FROM lineitem GROUP BY 1, 2, 3
""")
def page_opportunities(t: Tables) -> DataFrame:
    return diff.page_opportunities(supplier_evidence(t), ["l_suppkey", "page", "l_returnflag"])


def supplier_evidence(t: Tables) -> DataFrame:
    page = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return t.lineitem.select("l_suppkey", page.alias("page"), "l_returnflag", "l_orderkey")


@query("""
WITH e AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page, l_returnflag, l_orderkey FROM lineitem),
o AS (SELECT DISTINCT * FROM e), n AS (SELECT DISTINCT l_suppkey, page + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS page, l_returnflag, l_orderkey FROM e WHERE l_orderkey % 30 <> 1),
m AS (SELECT l_suppkey, page, l_returnflag, o.x IS NOT NULL AS a, n.x IS NOT NULL AS b FROM (SELECT *, 1 AS x FROM o) o FULL JOIN (SELECT *, 1 AS x FROM n) n USING (l_suppkey, page, l_returnflag, l_orderkey)),
u AS (SELECT l_suppkey, page, l_returnflag, count(*) FILTER (a) AS n_before, count(*) FILTER (b) AS n_after, count(*) FILTER (a AND NOT b) AS n_lost, count(*) FILTER (b AND NOT a) AS n_gained FROM m GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n_before = 0 THEN 'added' WHEN n_after = 0 THEN 'removed' WHEN n_lost > 0 OR n_gained > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM u
""")
def page_opportunities_diff(t: Tables) -> DataFrame:
    """Units before and after some evidence moved to the next page and some was dropped."""
    old = supplier_evidence(t)
    new = old.filter("l_orderkey % 30 <> 1").withColumn(
        "page", F.col("page") + F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)
    )
    return diff.opportunity_diff(old, new, ["l_suppkey", "page", "l_returnflag"], "l_orderkey")


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS source, l_returnflag AS type, l_suppkey AS target FROM lineitem),
i AS (SELECT * FROM (VALUES ('A', 'R'), ('R', 'A'), ('N', 'N')) v(type, inverse))
SELECT e.source, e.target, 'reversed' AS kind, e.type AS detail FROM e WHERE (e.source, e.type, e.target) IN (SELECT e2.target, i.inverse, e2.source FROM e e2 JOIN i ON e2.type = i.type WHERE NOT (e2.source = e2.target AND e2.type = i.inverse))
UNION ALL SELECT source, target, 'types', CAST(count(*) AS VARCHAR) FROM e GROUP BY 1, 2 HAVING count(*) > 1
""")
def edge_conflicts(t: Tables) -> DataFrame:
    """Part-to-supplier edges typed by return flag, in one space of ids."""
    edges = t.lineitem.select(
        F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("target")
    )
    return diff.edge_conflicts(edges, {"A": "R", "R": "A", "N": "N"})


@query("""
SELECT p_partkey, 'updated' AS status FROM part WHERE p_type <> 'PROMO' AND p_partkey % 40 = 0
UNION ALL SELECT p_partkey, 'removed' FROM part WHERE p_type <> 'PROMO' AND p_partkey % 41 = 0 AND p_partkey % 40 <> 0
""")
def retire(t: Tables) -> DataFrame:
    """Promotional parts are retired; the check names every other difference."""
    before = t.part.select("p_partkey", "p_name", "p_size", "p_type")
    ids = before.filter("p_type = 'PROMO'")
    after = diff.retire(before, ids, ["p_partkey"])
    key = F.col("p_partkey")
    after = after.filter((key % 41 != 0) | (key % 40 == 0)).withColumn(
        "p_size", F.when(key % 40 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    )
    seal = lambda d: d.withColumn("sha", record_sha(["p_name", "p_size"]))
    return diff.retire_check(seal(before), seal(after), ids, ["p_partkey"], "sha")


@query("""
SELECT 'C' || c_custkey AS id, 'undisposed' AS problem FROM customer WHERE c_custkey % 19 = 0
UNION ALL SELECT 'X' || c_custkey, 'unknown_old' FROM customer WHERE c_custkey % 23 = 0
UNION ALL SELECT DISTINCT 'N' || (c_custkey // 2), 'target_absent' FROM customer WHERE c_custkey % 19 <> 0 AND c_custkey % 5 <> 0 AND (c_custkey // 2) % 29 = 0
""")
def lineage_closure(t: Tables) -> DataFrame:
    """Old ids merge in pairs; some are forgotten, some strangers, some targets missing."""
    key = F.col("c_custkey")
    pair = F.call_function("div", key, F.lit(2).cast("bigint"))
    old = t.customer.select(F.concat(F.lit("C"), key).alias("id"))
    kept = t.customer.filter(key % 19 != 0).select(
        F.concat(F.lit("C"), key).alias("old_id"),
        F.when(key % 5 != 0, F.concat(F.lit("N"), pair)).alias("new_id"),
        F.when(key % 5 != 0, "merged").otherwise("removed").alias("disposition"),
    )
    strange = t.customer.filter(key % 23 == 0).select(
        F.concat(F.lit("X"), key).alias("old_id"), F.lit(None).cast("string").alias("new_id"), F.lit("removed").alias("disposition")
    )
    new = t.customer.filter(pair % 29 != 0).select(F.concat(F.lit("N"), pair).alias("id")).distinct()
    return diff.lineage_closure(old, kept.unionByName(strange), new)


@query("""
WITH l AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'retained' WHEN 'O' THEN 'revised' ELSE 'removed' END AS disposition FROM orders WHERE o_orderkey % 37 <> 0
           UNION ALL SELECT o_orderkey, 'removed' FROM orders WHERE o_orderkey % 41 = 0)
SELECT disposition AS kind, count(*) AS n FROM l GROUP BY 1
UNION ALL SELECT CASE WHEN c = 0 THEN 'missing' ELSE 'overlap' END, count(*) FROM (SELECT o.o_orderkey, count(l.o_orderkey) AS c FROM orders o LEFT JOIN l ON o.o_orderkey = l.o_orderkey GROUP BY 1) WHERE c <> 1 GROUP BY 1
""")
def proposal_partition(t: Tables) -> DataFrame:
    """Dispositions of orders with gaps and double entries."""
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    disposition = F.when(F.col("o_orderstatus") == "F", "retained").when(F.col("o_orderstatus") == "O", "revised").otherwise("removed")
    ledger = orders.filter("o_orderkey % 37 <> 0").select("o_orderkey", disposition.alias("disposition")).unionByName(
        orders.filter("o_orderkey % 41 = 0").select("o_orderkey", F.lit("removed").alias("disposition"))
    )
    counts, problems = diff.proposal_partition(ledger, orders, ["o_orderkey"])
    return counts.withColumnRenamed("disposition", "kind").unionByName(
        problems.groupBy("kind").agg(F.count("*").alias("n"))
    )


@query("""
SELECT p_brand, count(*) AS n_before, count(*) FILTER (NOT (p_brand = 'Brand#1' AND p_size > 40)) AS n_after, CAST(sum(p_size) AS BIGINT) AS weight_before,
       CAST(coalesce(sum(p_size) FILTER (NOT (p_brand = 'Brand#1' AND p_size > 40)), 0) AS BIGINT) AS weight_after,
       count(*) FILTER (p_brand = 'Brand#1' AND p_size > 40) = 0 AS equal
FROM part GROUP BY 1
""")
def population_accounting(t: Tables) -> DataFrame:
    """Part counts and sizes per brand before and after an amendment of one brand."""
    before = t.part.select("p_brand", "p_size")
    after = before.filter("not (p_brand = 'Brand#1' and p_size > 40)")
    return diff.population_accounting(before, after, ["p_brand"], "p_size")


# An order is a document of lines; the next version turns its lines round and changes some.
@query("""
WITH l AS (SELECT l_orderkey, l_linenumber AS n, any_value(l_partkey) AS part, any_value(l_returnflag) AS flag FROM lineitem GROUP BY ALL HAVING count(*) = 1),
a AS (SELECT l_orderkey, n, part, flag FROM l WHERE NOT (l_orderkey % 5 = 0 AND n = 2)),
b AS (SELECT l_orderkey, n, CASE WHEN l_orderkey % 3 = 0 AND n = 1 THEN part + 1 ELSE part END AS part, flag FROM l WHERE NOT (l_orderkey % 7 = 0 AND n = 1)),
x AS (SELECT l_orderkey, '/lines/n=' || n || unnest(['/n', '/part', '/note~1s/flag']) AS pointer, unnest([n::VARCHAR, part::VARCHAR, '"' || flag || '\\n\\\\"']) AS value FROM a),
y AS (SELECT l_orderkey, '/lines/n=' || n || unnest(['/n', '/part', '/note~1s/flag']) AS pointer, unnest([n::VARCHAR, part::VARCHAR, '"' || flag || '\\n\\\\"']) AS value FROM b)
SELECT l_orderkey, pointer, CASE WHEN x.value IS NULL THEN 'add' WHEN y.value IS NULL THEN 'remove' ELSE 'replace' END AS op, x.value AS before, y.value AS after
FROM x FULL JOIN y USING (l_orderkey, pointer) WHERE x.value IS DISTINCT FROM y.value AND l_orderkey IN (SELECT l_orderkey FROM a) AND l_orderkey IN (SELECT l_orderkey FROM b)
""")
def keyed_array_diff(t: Tables) -> DataFrame:
    """Orders as documents whose lines are turned round; only real changes of a line come out."""
    once = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.any_value("l_partkey").alias("part"), F.any_value("l_returnflag").alias("flag"), F.count("*").alias("_n")).filter("_n = 1")
    key, n = F.col("l_orderkey"), F.col("l_linenumber")

    def documents(lines: DataFrame, ascending: bool) -> DataFrame:
        note = F.struct(F.concat("flag", F.lit("\n\\")).alias("flag"))
        line = F.struct(n.alias("n"), "part", note.alias("note/s"))
        return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line), ascending).alias("lines")).select(
            "l_orderkey", F.to_json(F.struct("lines")).alias("json"))

    old = documents(once.filter(~((key % 5 == 0) & (n == 2))), True)
    changed = F.when((key % 3 == 0) & (n == 1), F.col("part") + 1).otherwise(F.col("part"))
    new = documents(once.filter(~((key % 7 == 0) & (n == 1))).withColumn("part", changed), False)
    both = [d.join(o.select("l_orderkey"), "l_orderkey", "left_semi") for d, o in ((old, new), (new, old))]
    return diff.diff_fields(*[diff.flatten_json(d, ["l_orderkey"], "json", array_key="n") for d in both], ["l_orderkey"])


NESTED_SQL = """
WITH ch AS (
  SELECT o_custkey AS k, 'header' AS component, '/orders/' || o_orderkey AS pointer FROM orders WHERE o_orderkey % 5 = 0
  UNION SELECT o_custkey, 'lines', '/orders/' || o_orderkey || '/lines/' || l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber < 4
  UNION SELECT o_custkey, 'audit', '/orders/' || o_orderkey || '/lines' FROM orders WHERE o_orderkey % 3 = 0
  UNION SELECT o_custkey, 'header', '/orders/' || o_orderkey || '/lines/1/flag' FROM orders WHERE o_orderkey % 10 = 0
  UNION SELECT c_custkey, 'audit', '' FROM customer WHERE c_custkey % 50 = 0)
"""


def nested_changes(t: Tables) -> DataFrame:
    """Changes at four depths of a customer's document, by three components."""
    orders = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    at = F.concat(F.lit("/orders/"), "o")
    lines = t.lineitem.filter("l_linenumber < 4").select(F.col("l_orderkey").alias("o"), "l_linenumber").join(orders, "o")

    def change(df: DataFrame, component: str, pointer) -> DataFrame:
        return df.select("k", F.lit(component).alias("component"), pointer.alias("pointer"))

    return (
        change(orders.filter("o % 5 = 0"), "header", at)
        .unionByName(change(lines, "lines", F.concat(at, F.lit("/lines/"), "l_linenumber")))
        .unionByName(change(orders.filter("o % 3 = 0"), "audit", F.concat(at, F.lit("/lines"))))
        .unionByName(change(orders.filter("o % 10 = 0"), "header", F.concat(at, F.lit("/lines/1/flag"))))
        .unionByName(change(t.customer.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("k")), "audit", F.lit("")))
    )


@query(NESTED_SQL + """
SELECT a.k, a.pointer, a.component, b.component AS inner_component, count(*) AS n_inner
FROM ch a JOIN ch b ON a.k = b.k AND starts_with(b.pointer, a.pointer || '/') AND a.component <> b.component GROUP BY ALL
""")
def nested_overlaps(t: Tables) -> DataFrame:
    return diff.nested_overlaps(nested_changes(t), ["k"])


@query(NESTED_SQL + """,
w AS (SELECT k, pointer FROM ch WHERE component = 'audit' AND k % 2 = 0 AND pointer LIKE '%lines'),
o AS (SELECT DISTINCT a.k, a.pointer, w.pointer IS NOT NULL AS ruled
      FROM ch a JOIN ch b ON a.k = b.k AND starts_with(b.pointer, a.pointer || '/') AND a.component <> b.component
      LEFT JOIN w ON w.k = a.k AND w.pointer = a.pointer),
j AS (SELECT ch.k, ch.pointer, bool_or(NOT o.ruled) AS still_open, bool_or(ch.component = 'audit') AS own
      FROM ch JOIN o ON o.k = ch.k AND starts_with(ch.pointer, o.pointer || '/') GROUP BY ALL),
s AS (SELECT k, pointer FROM j WHERE still_open UNION SELECT k, pointer FROM o WHERE NOT ruled),
f AS (SELECT k, pointer FROM j WHERE NOT still_open AND NOT own)
SELECT DISTINCT k, pointer, (k, pointer) IN (SELECT (k, pointer) FROM s) AS unresolved FROM ch WHERE (k, pointer) NOT IN (SELECT (k, pointer) FROM f) OR (k, pointer) IN (SELECT (k, pointer) FROM s)
""")
def resolve_nested(t: Tables) -> DataFrame:
    """Rules give the lines of every other customer to the audit; the other disputes stay open."""
    changes = nested_changes(t).distinct().withColumn("value", F.col("component"))
    rules = changes.filter("component = 'audit' and k % 2 = 0 and pointer like '%lines'").select("k", "pointer", "component")
    resolved, unresolved = diff.resolve_nested(changes, rules, ["k"])
    return resolved.select("k", "pointer", F.lit(False).alias("unresolved")).unionByName(
        unresolved.select("k", "pointer", F.lit(True).alias("unresolved")))


@query("""
SELECT l_orderkey, l_linenumber AS seq, count(DISTINCT (l_partkey, l_returnflag)) AS n_patches FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_partkey, l_returnflag)) > 1
""")
def patch_ties(t: Tables) -> DataFrame:
    """Order lines as patches of an order in the sequence of their numbers; some numbers repeat."""
    patches = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("seq"), "l_partkey", "l_returnflag")
    return diff.patch_ties(patches, ["l_orderkey"])


@query("""
SELECT p_brand, count(*) AS n_before, count(*) AS n_after, CAST(sum(p_size) AS BIGINT) AS weight_before, CAST(sum(p_size) AS BIGINT) AS weight_after,
       CAST(count(*) FILTER (p_partkey % 7 = 0) AS BIGINT) AS n_lost, CAST(count(*) FILTER (p_partkey % 7 = 0) AS BIGINT) AS n_gained, count(*) FILTER (p_partkey % 7 = 0) = 0 AS equal, true AS updated
FROM (SELECT p_partkey, p_size, nullif(p_brand, 'Brand#3') AS p_brand FROM part) GROUP BY ALL
""")
def population_swaps(t: Tables) -> DataFrame:
    """Every seventh part is another one of equal size; counts agree, digests don't.

    ``updated``: the digest of the new population equals that of the old one after
    the changes alone were added and taken away. One brand is NULL.
    """
    brand = F.when(F.col("p_brand") != "Brand#3", F.col("p_brand"))
    before = t.part.select(brand.alias("p_brand"), "p_partkey", "p_size")
    swapped = before.filter("p_partkey % 7 = 0")
    new = swapped.withColumn("p_partkey", -1 - F.col("p_partkey"))
    after = before.filter("p_partkey % 7 <> 0").unionByName(new)
    counts = diff.population_accounting(before, after, ["p_brand"], "p_size", ["p_partkey"]).drop("sha_before", "sha_after")
    seal = lambda d: d.withColumn("sha", record_sha(["p_partkey", "p_size"]))
    state = identity.multiset_state(seal(before), ["p_brand"], "sha")
    updated = identity.update_state(state, seal(new), seal(swapped), ["p_brand"], "sha")
    digests = diff.diff_records(identity.population_digest(updated, ["p_brand"]),
                                identity.population_digest(identity.multiset_state(seal(after), ["p_brand"], "sha"), ["p_brand"]),
                                ["p_brand"], "population_sha")
    met = digests.select(F.col("p_brand").alias("_b"), (F.col("status") == "unchanged").alias("updated"))
    return counts.join(met, F.col("p_brand").eqNullSafe(F.col("_b"))).drop("_b")


@query("""
WITH RECURSIVE v AS (SELECT range AS v FROM range(10)),
m AS (
  SELECT v || ':' || c_custkey AS a, CASE WHEN c_custkey % 17 = v THEN NULL WHEN v % 3 = 1 THEN (v + 1) || ':' || (c_custkey // 2) ELSE (v + 1) || ':' || c_custkey END AS b FROM customer, v
  UNION SELECT v || ':' || c_custkey, (v + 1) || ':' || (c_custkey + 1) FROM customer, v WHERE c_custkey % 11 = v
  UNION SELECT 'x' || c_custkey, 'x' || (c_custkey - c_custkey % 3 + (c_custkey + 1) % 3) FROM customer WHERE c_custkey % 60 < 3),
r AS (SELECT a, b, 1 AS n FROM m UNION ALL SELECT r.a, m.b, n + 1 FROM r JOIN m ON r.b = m.a WHERE n < 20)
SELECT a AS id, b AS final_id, CASE WHEN b IS NULL THEN 'removed' ELSE 'current' END AS status, count(*) AS n_paths, max(n)::BIGINT AS n_steps
FROM r WHERE b IS NULL OR b NOT IN (SELECT a FROM m) GROUP BY ALL
UNION ALL SELECT a, 'x' || (substr(a, 2)::BIGINT // 3 * 3), 'cycle', NULL, NULL FROM m WHERE a LIKE 'x%'
""")
def lineage_chains(t: Tables) -> DataFrame:
    """Ids of ten versions: they merge in pairs, split and go; rings of three never end."""
    key = F.col("c_custkey")
    half = F.expr("c_custkey div 2")
    steps = t.customer.select("c_custkey", F.explode(F.expr("sequence(0, 9)")).alias("v"))
    v = F.col("v")

    def name(version, k):
        return F.concat(version.cast("string"), F.lit(":"), k.cast("string"))

    straight = steps.select(name(v, key).alias("old_id"), F.when(key % 17 == v, F.lit(None)).when(v % 3 == 1, name(v + 1, half)).otherwise(
        name(v + 1, key)).alias("new_id"))
    split = steps.filter(key % 11 == v).select(name(v, key).alias("old_id"), name(v + 1, key + 1).alias("new_id"))
    rings = t.customer.filter("c_custkey % 60 < 3").select(
        F.concat(F.lit("x"), key).alias("old_id"), F.concat(F.lit("x"), key - key % 3 + (key + 1) % 3).alias("new_id"))
    found = diff.lineage_chains(straight.unionByName(split).unionByName(rings))
    # Which id of a ring stands for it depends on the number of rounds; name the ring's first.
    ring = F.concat(F.lit("x"), F.expr("cast(substr(final_id, 2) as bigint) div 3 * 3"))
    return found.withColumn("final_id", F.when(F.col("status") == "cycle", ring).otherwise(F.col("final_id")))

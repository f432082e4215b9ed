"""Queries: digests, manifests, profiles and registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.canonical import canonical_sha, record_json, record_sha
from folioscope.operators import identity
from folioscope.plans.registry import Tables, query

CUSTOMER_FIELDS = ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"]
CUSTOMER_JSON = (
    "'{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey"
)


def changed_customers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers and a derived next version: changed, dropped and added records."""
    old = t.customer.select(*CUSTOMER_FIELDS)
    key = F.col("c_custkey")
    kept = old.filter(key % 13 != 0).withColumns({
        "c_nationkey": F.when(key % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")),
        "c_mktsegment": F.when(key % 11 == 0, F.lit("RETIRED")).otherwise(F.col("c_mktsegment")),
    })
    added = old.filter(key % 50 == 0).withColumn("c_custkey", -1 - key)
    return old, kept.unionByName(added)


CHANGED_SQL = """
WITH v1 AS (SELECT c_custkey, c_mktsegment, c_name, c_nationkey FROM customer),
v2 AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'RETIRED' ELSE c_mktsegment END AS c_mktsegment, c_name,
              CASE WHEN c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 13 <> 0
       UNION ALL SELECT -1 - c_custkey, c_mktsegment, c_name, c_nationkey FROM customer WHERE c_custkey % 50 = 0)
"""


@query(f"SELECT c_custkey, sha256({CUSTOMER_JSON} || '}}') AS sha FROM customer")
def record_digest(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", record_sha(CUSTOMER_FIELDS).alias("sha"))


@query("""
SELECT event_id, sha256('{"a":[1,2],"p":' || replace(props, ' ', '') || ',"z":' || event_id || '}') AS sha FROM events
""")
def canonical_digest(t: Tables) -> DataFrame:
    """Raw JSON with loose spacing and unsorted keys."""
    raw = F.concat(F.lit('{ "z" : '), "event_id", F.lit(', "p": '), "props", F.lit(', "a": [1, 2 ] }'))
    return t.events.select("event_id", canonical_sha(raw).alias("sha"))


@query("SELECT c_custkey, c_custkey % 7 <> 0 AS self_hash_ok FROM customer")
def self_hash(t: Tables) -> DataFrame:
    """Records that carry their own digest; every seventh digest is wrong."""
    body = record_json(CUSTOMER_FIELDS)
    digest = F.when(F.col("c_custkey") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(body, 256))
    sealed = F.concat(F.lit('{"release_sha256":"'), digest, F.lit('",'), F.substr(body, F.lit(2)))
    return t.customer.select(
        "c_custkey", identity.self_hash_ok(sealed, "release_sha256").alias("self_hash_ok")
    )


@query(f"""
SELECT c_custkey, sha256({CUSTOMER_JSON} || '}}') AS semantic_sha, true AS equal_across_wrappers FROM customer
""")
def semantic_digest(t: Tables) -> DataFrame:
    """One content in two wrappers has one digest once the wrapper fields are gone."""
    body = F.substr(record_json(CUSTOMER_FIELDS), F.lit(2))
    wrapped = lambda who: F.concat(F.lit(f'{{"frozen_by":"{who}","release_id":"R-'), "c_custkey", F.lit('",'), body)
    digest = lambda who: identity.semantic_sha(wrapped(who), ["frozen_by", "release_id"])
    return t.customer.select(
        "c_custkey", digest("a").alias("semantic_sha"), (digest("a") == digest("b")).alias("equal_across_wrappers")
    )


@query(f"""
WITH h AS (SELECT c_mktsegment, sha256({CUSTOMER_JSON} || '}}') AS h FROM customer, range(1 + c_custkey % 2)),
l AS (SELECT c_mktsegment, h AS p, h || ':' || count(*) AS d, count(*) AS n FROM h GROUP BY c_mktsegment, h),
l6 AS (SELECT c_mktsegment, p[1:6] AS p, sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l GROUP BY c_mktsegment, p[1:6]),
l4 AS (SELECT c_mktsegment, p[1:4] AS p, sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l6 GROUP BY c_mktsegment, p[1:4]),
l2 AS (SELECT c_mktsegment, p[1:2] AS p, sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l4 GROUP BY c_mktsegment, p[1:2])
SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n_records, sha256(string_agg(d, ',' ORDER BY d)) AS population_sha FROM l2 GROUP BY c_mktsegment
""".replace(", range(1 + c_custkey % 2)", ", (VALUES (0), (1)) r(i) WHERE i <= c_custkey % 2"))
def population_digest(t: Tables) -> DataFrame:
    """One digest per segment; every odd customer occurs twice."""
    rows = t.customer.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 2).cast("int"))))
    rows = rows.select("c_mktsegment", record_sha(CUSTOMER_FIELDS).alias("sha"))
    return identity.population_sha(rows, ["c_mktsegment"], "sha")


@query("""
WITH b AS (SELECT 'c/' || o_custkey AS path, CASE WHEN o_orderkey % 10 = 0 THEN sha256('x') ELSE sha256('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) END AS sha, 18 AS bytes, count(*) AS n
           FROM orders GROUP BY 1, 2),
f AS (SELECT 'c/' || c_custkey AS path, sha256(c_name) AS sha FROM customer WHERE c_custkey % 7 <> 0)
SELECT b.path, b.n AS n_bindings, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.sha = b.sha THEN 'ok' ELSE 'mismatch' END AS status FROM b LEFT JOIN f USING (path)
UNION ALL SELECT path, 0, 'undeclared' FROM f WHERE path NOT IN (SELECT path FROM b)
""")
def manifest_audit(t: Tables) -> DataFrame:
    """Orders bind their customer's name; some files are gone and some hashes wrong."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    bindings = t.orders.select(
        F.concat(F.lit("c/"), "o_custkey").alias("path"),
        F.when(F.col("o_orderkey") % 10 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(name, 256)).alias("sha256"),
        F.lit(18).cast("bigint").alias("bytes"),
    )
    files = t.customer.filter("c_custkey % 7 <> 0").select(
        F.concat(F.lit("c/"), "c_custkey").alias("path"), F.sha2("c_name", 256).alias("sha256"),
        F.length("c_name").cast("bigint").alias("bytes"),
    )
    return identity.audit_manifest(bindings, files)


@query("""
WITH b AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN '../' || regexp_replace(url, '^https?://', '')
                  ELSE replace(regexp_replace(url, '^https?://', ''), '/', chr(92)) END AS path,
         CASE WHEN page_id % 5 = 0 THEN upper(sha256(html)) ELSE sha256(html) END AS sha FROM pages)
SELECT page_id, regexp_full_match(sha, '[a-f0-9]{64}') AS sha_ok,
       path <> '' AND NOT contains(path, chr(92)) AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS path_ok,
       regexp_full_match(sha[1:40], '[a-f0-9]{40}') AS commit_ok FROM b
""")
def binding_shape(t: Tables) -> DataFrame:
    """Page addresses as paths: absolute, plain, climbing and with backslashes."""
    bare = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 4
    path = (
        F.when(kind == 0, F.col("url")).when(kind == 1, bare).when(kind == 2, F.concat(F.lit("../"), bare))
        .otherwise(F.replace(bare, F.lit("/"), F.lit("\\")))
    )
    sha = F.sha2("html", 256)
    bindings = t.pages.select(
        "page_id", path.alias("path"), F.when(F.col("page_id") % 5 == 0, F.upper(sha)).otherwise(sha).alias("sha256")
    )
    shaped = identity.binding_shape(bindings)
    return shaped.select(
        "page_id", "sha_ok", "path_ok", identity.commit_shape(F.substring("sha256", 1, 40)).alias("commit_ok")
    )


@query("""
WITH b AS (SELECT l_orderkey AS release_id, 'p/' || l_partkey AS path, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT release_id, path, 'duplicate_path' AS problem, n FROM b WHERE n > 1
UNION ALL SELECT b.release_id, b.path, 'binds_itself', n FROM b JOIN orders ON b.release_id = o_orderkey AND b.path = 'p/' || (o_custkey % 200)
""")
def binding_dupes(t: Tables) -> DataFrame:
    bindings = t.lineitem.select(
        F.col("l_orderkey").alias("release_id"), F.concat(F.lit("p/"), "l_partkey").alias("path")
    )
    own = t.orders.select(
        F.col("o_orderkey").alias("release_id"), F.concat(F.lit("p/"), F.col("o_custkey") % 200).alias("path")
    )
    return identity.binding_dupes(bindings, own)


ROLE_LIST = identity.BASE_ROLES + identity.ACCESS_ROLES + ["appendix"]
ROLE_SQL = "[" + ", ".join(f"'{r}'" for r in ROLE_LIST) + "]"


@query(f"""
WITH b AS (SELECT l_orderkey AS release_id, ['v8', 'v9', 'v10'][1 + l_orderkey % 3] AS profile, {ROLE_SQL}[1 + (l_partkey + l_linenumber) % 12] AS role FROM lineitem),
req AS (SELECT DISTINCT release_id, unnest({ROLE_SQL}[1:CASE WHEN profile = 'v10' THEN 11 ELSE 9 END]) AS role FROM b),
n AS (SELECT release_id, role, count(*) AS n FROM b GROUP BY 1, 2)
SELECT role, CASE WHEN n.n IS NULL THEN 'missing' WHEN r.x IS NULL THEN 'extra' ELSE 'repeated' END AS problem, count(*) AS n_releases
FROM (SELECT *, 1 AS x FROM req) r FULL JOIN n USING (release_id, role) WHERE n.n IS NULL OR r.x IS NULL OR n.n > 1 GROUP BY 1, 2
""")
def role_check(t: Tables) -> DataFrame:
    """Orders as releases whose lines bind roles; counted over all releases."""
    profile = F.element_at(F.array(*[F.lit(p) for p in ("v8", "v9", "v10")]), (1 + F.col("l_orderkey") % 3).cast("int"))
    role = F.element_at(
        F.array(*[F.lit(r) for r in ROLE_LIST]), (1 + (F.col("l_partkey") + F.col("l_linenumber")) % 12).cast("int")
    )
    bindings = t.lineitem.select(F.col("l_orderkey").alias("release_id"), profile.alias("profile"), role.alias("role"))
    found = identity.role_check(bindings, identity.role_table())
    return found.groupBy("role", "problem").agg(F.count("*").alias("n_releases"))


@query("""
WITH r AS (SELECT event_type, user_id % 3 AS v, CASE WHEN event_id % 8 = 0 THEN 'zzz' ELSE 'pin-' || (user_id % 3) END AS revision FROM events),
p AS (SELECT * FROM (VALUES (0, 'v8', 'pin-0'), (1, 'v9', 'pin-1')) x(v, profile, pin))
SELECT event_type, profile, CASE WHEN profile IS NULL THEN 'unknown_version' WHEN pin = revision THEN 'ok' ELSE 'pin_differs' END AS status, count(*) AS n
FROM r LEFT JOIN p USING (v) GROUP BY 1, 2, 3
""")
def profile_lookup(t: Tables) -> DataFrame:
    releases = t.events.select(
        "event_type", F.concat(F.lit("release-v"), F.col("user_id") % 3).alias("schema_version"),
        F.when(F.col("event_id") % 8 == 0, "zzz").otherwise(F.concat(F.lit("pin-"), F.col("user_id") % 3)).alias("revision"),
    )
    profiles = {"release-v0": ("v8", "pin-0"), "release-v1": ("v9", "pin-1")}
    found = identity.select_profile(releases, profiles)
    return found.groupBy("event_type", "profile", "status").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT user_id AS state, event_type AS stage, 'd' || day(ts) AS schema_version, count(*) AS n, max('e/' || event_id) AS reg, min('e/' || event_id) AS lo, min(event_id) AS id FROM events GROUP BY 1, 2, 3),
e AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'x/' || id ELSE 'e/' || id END AS path FROM g)
SELECT state, stage, schema_version, n, CASE WHEN n <> 1 THEN 'not_exactly_one' WHEN reg = path THEN 'ok' ELSE 'path_or_hash_differs' END AS status FROM e
""")
def unique_registration(t: Tables) -> DataFrame:
    """A user's events of one kind on one day as registrations of one artifact."""
    keys = ["state", "stage", "schema_version"]
    rows = t.events.select(
        F.col("user_id").alias("state"), F.col("event_type").alias("stage"),
        F.concat(F.lit("d"), F.dayofmonth("ts")).alias("schema_version"), "event_id",
    )
    registered = rows.withColumn("path", F.concat(F.lit("e/"), "event_id")).withColumn("sha256", F.lit("s"))
    expected = rows.groupBy(*keys).agg(F.min("event_id").alias("id")).select(
        *keys, F.concat(F.when(F.col("id") % 5 == 0, "x/").otherwise("e/"), "id").alias("path"), F.lit("s").alias("sha256")
    )
    return identity.unique_registration(registered, expected).select(*keys, "n", "status")


@query("""
WITH m AS (SELECT l_orderkey AS a, l_linenumber AS i, count(*) AS n, min(l_partkey % 3) AS lo FROM lineitem GROUP BY 1, 2),
d AS (SELECT o_orderkey AS a, i FROM orders, (VALUES (1), (2), (3)) v(i)),
j AS (SELECT coalesce(m.a, d.a) AS a, coalesce(m.i, d.i) AS i, coalesce(n, 0) AS n, lo, d.a IS NOT NULL AS declared FROM m FULL JOIN d ON m.a = d.a AND m.i = d.i)
SELECT status, count(*) AS n_names, CAST(sum(n) AS BIGINT) AS n_members FROM (
  SELECT n, CASE WHEN NOT declared THEN 'undeclared' WHEN n = 0 THEN 'absent' WHEN n > 1 THEN 'duplicate' WHEN i = 3 THEN 'unbound' WHEN lo = i - 1 THEN 'ok' ELSE 'differs' END AS status FROM j)
GROUP BY 1
""")
def bundle_audit(t: Tables) -> DataFrame:
    """Orders as archives: line numbers are member names, three are declared, two are bound."""
    members = t.lineitem.select(
        F.col("l_orderkey").alias("archive"), F.concat(F.lit("m"), "l_linenumber").alias("name"),
        F.sha2((F.col("l_partkey") % 3).cast("string"), 256).alias("sha256"),
    )
    declared = t.orders.select(
        F.col("o_orderkey").alias("archive"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i")
    ).select("archive", F.concat(F.lit("m"), "i").alias("name"), F.concat(F.lit("a/"), "i").alias("artifact_path"))
    bindings = t.spark.createDataFrame([("a/1", "0"), ("a/2", "1")], "path string, v string").select(
        "path", F.sha2("v", 256).alias("sha256")
    )
    found = identity.audit_bundle(members, declared, bindings)
    return found.groupBy("status").agg(F.count("*").alias("n_names"), F.sum("n_members").cast("bigint").alias("n_members"))


@query("""
SELECT l_orderkey AS archive, count(DISTINCT r) AS n_required_roles, count(DISTINCT r) = 4 AS complete
FROM (SELECT l_orderkey, CASE WHEN (l_partkey + l_linenumber) % 6 < 4 THEN (l_partkey + l_linenumber) % 6 END AS r FROM lineitem) GROUP BY 1
""")
def bundle_roles(t: Tables) -> DataFrame:
    """Whether an archive's members cover the four artifacts every freeze needs."""
    held = t.lineitem.select(
        F.col("l_orderkey").alias("archive"),
        F.concat(F.lit("a/"), (F.col("l_partkey") + F.col("l_linenumber")) % 6).alias("artifact_path"),
    )
    rows = [(f"a/{i}", role) for i, role in enumerate(identity.FREEZE_ROLES)]
    bindings = t.spark.createDataFrame(rows, "path string, role string")
    return identity.bundle_roles(held, bindings, identity.FREEZE_ROLES)


@query(CHANGED_SQL + """
SELECT coalesce(v1.c_custkey, v2.c_custkey) AS path,
       CASE WHEN v2.c_custkey IS NULL THEN 'gone' WHEN v1.c_custkey IS NULL THEN 'new' WHEN v1.c_nationkey = v2.c_nationkey AND v1.c_mktsegment = v2.c_mktsegment THEN 'unchanged' ELSE 'changed' END AS status
FROM v1 FULL JOIN v2 ON v1.c_custkey = v2.c_custkey
""")
def unchanged_since(t: Tables) -> DataFrame:
    old, new = changed_customers(t)
    sealed = [d.select(F.col("c_custkey").alias("path"), record_sha(CUSTOMER_FIELDS).alias("sha256")) for d in (old, new)]
    return identity.unchanged(*sealed)


@query("""
SELECT s_nationkey, count(*) AS n_candidates, count(DISTINCT s_suppkey % 2) = 1 AS lock_sha_common, true AS policy_sha_common, true AS own_wrappers
FROM supplier GROUP BY 1
""")
def common_bindings(t: Tables) -> DataFrame:
    """Suppliers of a nation as candidates that should share a lock and a policy."""
    candidates = t.supplier.select(
        "s_nationkey", "s_suppkey", F.sha2((F.col("s_suppkey") % 2).cast("string"), 256).alias("lock_sha"),
        F.sha2(F.col("s_nationkey").cast("string"), 256).alias("policy_sha"),
    )
    return identity.common_bindings(candidates, ["s_nationkey"], ["lock_sha", "policy_sha"], "s_suppkey")


EXPECTED_SQL = "(VALUES ('PROMO', 331), ('SMALL', 350), ('TINY', 1), ('LARGE', 340)) e(p_type, n)"


@query(f"""
WITH a AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
SELECT coalesce(a.p_type, e.p_type) AS p_type, CAST(e.n AS BIGINT) AS expected, a.n AS actual, e.n IS NOT DISTINCT FROM a.n AS ok FROM a FULL JOIN {EXPECTED_SQL} ON a.p_type = e.p_type
""")
def expected_counts(t: Tables) -> DataFrame:
    expected = t.spark.createDataFrame(
        [("PROMO", 331), ("SMALL", 350), ("TINY", 1), ("LARGE", 340)], "p_type string, n bigint"
    )
    return identity.expect(t.part.groupBy("p_type").agg(F.count("*").alias("n")), expected, ["p_type"], "n")


@query("""
SELECT c_custkey, coalesce(n_regionkey = c_custkey % 5, false) AS scope_ok FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def scope_binding(t: Tables) -> DataFrame:
    """Customers carry a region that must be their nation's."""
    artifacts = t.customer.select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 5).cast("int").alias("n_regionkey")
    )
    return identity.scope_binding(artifacts, t.nation, "n_nationkey", ["n_regionkey"]).select("c_custkey", "scope_ok")

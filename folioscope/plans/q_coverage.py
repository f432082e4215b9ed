"""Queries: set algebra, integrity and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.numbers import bucket_of
from folioscope.operators import coverage, intervals, near
from folioscope.plans.registry import Tables, query


def month_index(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS kind
FROM (SELECT doc_id FROM documents WHERE lang <> 'de') d FULL JOIN labels l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL
""")
def closure_missing_extra(t: Tables) -> DataFrame:
    """Documents without a label, and labels of documents left out on purpose."""
    return coverage.closure(t.documents.filter("lang <> 'de'"), t.labels, ["doc_id"])


@query("""
SELECT source, lang, count(*) AS inventory, count(l.doc_id) AS reviewed,
       CAST((2 * count(l.doc_id) * 1000000 + count(*)) // (2 * count(*)) / 1000000.0 AS DECIMAL(24,6)) AS reviewed_ratio
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2
""")
def coverage_ledger(t: Tables) -> DataFrame:
    docs = t.documents.select("source", "lang", "doc_id")
    reviewed = t.labels.select("doc_id").join(docs, "doc_id")
    return coverage.coverage_ratio(reviewed, docs, ["source", "lang"], ["doc_id"])


@query("""
WITH a AS (
  SELECT c_custkey AS k FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0
  UNION ALL SELECT -1 - c_custkey FROM customer WHERE c_custkey % 17 = 0),
n AS (SELECT k, count(*) AS n FROM a GROUP BY 1)
SELECT coalesce(c_custkey, k) AS k, CASE WHEN c_custkey IS NULL THEN 'extra' WHEN k IS NULL THEN 'missing' ELSE 'overlap' END AS kind,
       coalesce(n, 0) AS n_assigned
FROM customer FULL JOIN n ON c_custkey = k WHERE c_custkey IS NULL OR k IS NULL OR n > 1
""")
def partition_check(t: Tables) -> DataFrame:
    """Customers assigned to reviewers with gaps, double assignments and strangers."""
    key = t.customer.select(F.col("c_custkey").alias("k"))
    assigned = key.select(F.explode(F.array_compact(F.array(
        F.when(F.col("k") % 11 != 0, F.col("k")), F.when(F.col("k") % 13 == 0, F.col("k")),
        F.when(F.col("k") % 17 == 0, -1 - F.col("k")),
    ))).alias("k"))
    return coverage.partition_check(assigned, key, ["k"])


@query("""
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-07-20')
""")
def complement(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderdate < timestamp_ntz'1995-07-20'").select(F.col("o_custkey").alias("c_custkey"))
    return coverage.complement(t.customer.select("c_custkey", "c_mktsegment"), done, ["c_custkey"])


@query("""
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY ALL),
b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL)
SELECT user_id, event_type, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right
FROM a FULL JOIN b USING (user_id, event_type) WHERE a.n IS DISTINCT FROM b.n
""")
def multiset_diff(t: Tables) -> DataFrame:
    """Two versions of the event list that each lost other rows."""
    columns = ["user_id", "event_type"]
    return coverage.multiset_diff(
        t.events.filter("event_id % 9 <> 0"), t.events.filter("event_id % 10 <> 0"), columns
    )


@query("""
SELECT l_returnflag, count(*) AS unique_keys, CAST(sum(n) AS BIGINT) AS bindings,
       CAST(sum(n) - count(*) AS BIGINT) AS duplicate_bindings, count(*) FILTER (n > 1) AS keys_with_overlap
FROM (SELECT l_returnflag, l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1
""")
def union_accounting(t: Tables) -> DataFrame:
    return coverage.union_accounting(t.lineitem, ["l_partkey", "l_suppkey"], ["l_returnflag"])


BUCKETS_SQL = "(VALUES ('B1', 0, 99), ('B2', 100, 399), ('B3', 400, 1499)) b(bucket, lo, hi)"


@query(f"""
WITH f AS (SELECT o_custkey, min(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) AS first_page, count(*) AS n_evidence FROM orders GROUP BY 1)
SELECT o_custkey, CAST(first_page AS BIGINT) AS first_page, n_evidence, bucket FROM f LEFT JOIN {BUCKETS_SQL} ON first_page BETWEEN lo AND hi
""")
def first_page_assignment(t: Tables) -> DataFrame:
    """Customers go to the bucket of their earliest order day."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    buckets = t.spark.createDataFrame(
        [("B1", 0, 99), ("B2", 100, 399), ("B3", 400, 1499)], "bucket string, lo bigint, hi bigint"
    )
    evidence = t.orders.select("o_custkey", day.alias("day"))
    return coverage.assign_by_first_page(evidence, buckets, [], "o_custkey", "day")


@query(f"""
WITH f AS (SELECT o_custkey, min(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) AS first_page FROM orders WHERE o_custkey % 10 <> 0 GROUP BY 1)
SELECT o_orderkey, o_custkey, bucket FROM orders LEFT JOIN (SELECT o_custkey, bucket FROM f LEFT JOIN {BUCKETS_SQL} ON first_page BETWEEN lo AND hi) USING (o_custkey)
""")
def children_buckets(t: Tables) -> DataFrame:
    """Orders take the bucket of their customer; every tenth customer was not assigned."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    buckets = t.spark.createDataFrame(
        [("B1", 0, 99), ("B2", 100, 399), ("B3", 400, 1499)], "bucket string, lo bigint, hi bigint"
    )
    evidence = t.orders.filter("o_custkey % 10 <> 0").select("o_custkey", day.alias("day"))
    assigned = coverage.assign_by_first_page(evidence, buckets, [], "o_custkey", "day")
    return coverage.follow_parent(t.orders.select("o_orderkey", "o_custkey"), assigned, ["o_custkey"])


@query("""
WITH f AS (SELECT user_id, min(event_id) AS first_position FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY first_position) AS rank FROM f)
SELECT user_id, first_position, rank, bucket FROM r LEFT JOIN (VALUES ('A', 1, 40), ('B', 41, 100)) b(bucket, lo, hi) ON rank BETWEEN lo AND hi
""")
def rank_assignment(t: Tables) -> DataFrame:
    """Users go to buckets by their order of first appearance."""
    rows = t.events.select(F.lit("all").alias("scope"), "user_id", "event_id")
    ranges = t.spark.createDataFrame([("A", 1, 40), ("B", 41, 100)], "bucket string, lo bigint, hi bigint")
    return coverage.assign_by_rank(rows, ["scope"], "user_id", "event_id", ranges).drop("scope")


@query("""
WITH tasks AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2),
facets AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber % 2 AS INTEGER) AS facet, l_partkey FROM lineitem WHERE l_linenumber <= 3)
SELECT l_orderkey, facet, count(*) AS n_ids, count(*) FILTER (tasks.l_partkey IS NULL) AS n_outside, count(*) FILTER (tasks.l_partkey IS NULL) = 0 AS subset_ok
FROM facets LEFT JOIN tasks USING (l_orderkey, l_partkey) GROUP BY 1, 2
""")
def facet_subset(t: Tables) -> DataFrame:
    """Facets of an order name parts; its task names the parts of later lines only."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    facets = lines.filter("l_linenumber <= 3").withColumn("facet", F.col("l_linenumber") % 2)
    tasks = lines.filter("l_linenumber >= 2")
    return coverage.facet_subset_bindings(facets, tasks, ["l_orderkey"], "facet", "l_partkey")


@query("""
SELECT p_partkey, p_type AS facet_id, CAST(len(list_filter([p_partkey, p_size], lambda x: x NOT IN (p_partkey, p_partkey % 50))) AS BIGINT) AS n_outside,
       len(list_filter([p_partkey, p_size], lambda x: x NOT IN (p_partkey, p_partkey % 50))) = 0 AS subset_ok
FROM part
""")
def facet_subset_records(t: Tables) -> DataFrame:
    """The record form: arrays of ids inside facets and tasks."""
    ids = lambda a, b: F.array(a.cast("bigint"), b.cast("bigint")).alias("subject_ids")
    key, size = F.col("p_partkey"), F.col("p_size")
    facets = t.part.select("p_partkey", F.col("p_type").alias("facet_id"), ids(key, size))
    tasks = t.part.select("p_partkey", ids(key, key % 50))
    return coverage.facet_subset(facets, tasks, ["p_partkey"], "subject_ids").drop("subject_ids")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dangling_refs(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey")
    return coverage.dangling(orders, t.lineitem, ["o_orderkey"], ["l_orderkey"])


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey + 1 FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def uncovered_subjects(t: Tables) -> DataFrame:
    """Customers no urgent order names; an order names its customer and the next one."""
    tasks = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("subject_ids")
    )
    return coverage.uncovered(t.customer.select("c_custkey"), tasks, "c_custkey", "subject_ids")


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_type = 'PROMO' THEN 'p_type' END, CASE WHEN p_size % 10 = 0 THEN 'p_size' END], lambda x: x IS NOT NULL), ',') AS empty_fields
FROM part WHERE p_type = 'PROMO' OR p_size % 10 = 0
""")
def empty_required(t: Tables) -> DataFrame:
    """Required fields that are NULL or blank."""
    part = t.part.select(
        "p_partkey", F.when(F.col("p_type") == "PROMO", " ").otherwise(F.col("p_type")).alias("p_type"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("p_size"),
    )
    found = coverage.empty_required(part, ["p_partkey"], ["p_type", "p_size"])
    return found.withColumn("empty_fields", F.array_join("empty_fields", ","))


@query("""
WITH m AS (SELECT l_orderkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page, l_linenumber AS i FROM lineitem)
SELECT DISTINCT l_orderkey, page FROM m
WHERE i <= 2 AND NOT EXISTS (SELECT 1 FROM m AS e WHERE e.i >= 2 AND e.l_orderkey = m.l_orderkey AND e.page = m.page)
""")
def page_scope(t: Tables) -> DataFrame:
    """Ship months of an order's first lines that none of its later lines share."""
    lines = t.lineitem.select("l_orderkey", month_index(F.col("l_shipdate")).alias("page"), "l_linenumber")
    return coverage.page_scope(
        lines.filter("l_linenumber <= 2"), lines.filter("l_linenumber >= 2"), ["l_orderkey"], "page"
    )


@query("""
SELECT DISTINCT l_orderkey AS o_orderkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE year(l_shipdate) * 12 + month(l_shipdate) NOT BETWEEN year(o_orderdate) * 12 + month(o_orderdate) AND year(o_orderdate) * 12 + month(o_orderdate) + 35
""")
def page_range_scope(t: Tables) -> DataFrame:
    """Ship months outside the 36 months that begin with the order."""
    first = month_index(F.col("o_orderdate"))
    owners = t.orders.select("o_orderkey", first.alias("lo"), (first + 35).alias("hi"))
    nested = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), month_index(F.col("l_shipdate")).alias("page"))
    return coverage.page_range_scope(nested, owners, ["o_orderkey"], "page")


@query("""
SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page, count(*) AS n FROM lineitem
WHERE year(l_shipdate) * 12 + month(l_shipdate) IN (SELECT year(o_orderdate) * 12 + month(o_orderdate) FROM orders GROUP BY 1 HAVING count(*) % 3 = 0)
GROUP BY 1
""")
def excluded_pages(t: Tables) -> DataFrame:
    """Shipments in excluded months: those whose number of orders divides by three."""
    by_month = t.orders.groupBy(month_index(F.col("o_orderdate")).alias("page")).count()
    refs = t.lineitem.select(month_index(F.col("l_shipdate")).alias("page"))
    found = coverage.excluded_pages(refs, by_month.filter("count % 3 = 0"), ["page"])
    return found.groupBy("page").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_edges(t: Tables) -> DataFrame:
    return coverage.dupes(t.lineitem, ["l_suppkey", "l_returnflag", "l_partkey"])


NEAR_SQL = """
WITH f AS (SELECT {by}, trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS form, count(*) AS n, min(id) AS first_id FROM ({labels}) GROUP BY ALL),
n AS (SELECT {by}, sha256(array_to_string(list_sort(list_distinct(string_split(form, ' '))), ' ')) AS key, CAST(sum(n) AS BIGINT) AS n_labels, count(*) AS n_forms, min(first_id) AS first_id
      FROM f GROUP BY 1, 2)
SELECT {by}, 'exact' AS kind, sha256(form) AS key, n AS n_labels, CAST(1 AS BIGINT) AS n_forms, first_id FROM f WHERE n > 1
UNION ALL SELECT {by}, 'near', key, n_labels, n_forms, first_id FROM n WHERE n_forms > 1
"""


@query(NEAR_SQL.format(by="p_type", labels="""
SELECT p_type, p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(string_split(p_name, ' ')[2]) || ', ' || string_split(p_name, ' ')[1] END AS label FROM part"""))
def near_dupes(t: Tables) -> DataFrame:
    """Part names, half of them turned round the way an index inverts a name."""
    words = F.split("p_name", " ")
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(
        F.concat(F.upper(F.get(words, F.lit(1))), F.lit(", "), F.get(words, F.lit(0)))
    )
    labels = t.part.select("p_type", F.col("p_partkey").alias("id"), label.alias("label"))
    return coverage.near_dupes(labels, ["p_type"], "label", "id")


@query(NEAR_SQL.format(by="lang", labels="SELECT lang, doc_id AS id, text AS label FROM documents"))
def near_dupe_texts(t: Tables) -> DataFrame:
    """The same rule over whole document texts."""
    labels = t.documents.select("lang", F.col("doc_id").alias("id"), F.col("text").alias("label"))
    return coverage.near_dupes(labels, ["lang"], "label", "id")


CLASSES_SQL = """
WITH RECURSIVE {labels},
e AS ({links}),
r(lang, id, root) USING KEY (lang, id) AS (
  SELECT lang, id, id FROM l
  UNION SELECT e.lang, e.b, min(r.root) FROM r JOIN e ON e.lang = r.lang AND e.a = r.id
        JOIN recurring.r AS o ON o.lang = e.lang AND o.id = e.b WHERE r.root < o.root GROUP BY ALL),
c AS (SELECT lang, id, root AS class_id FROM r)
SELECT c.lang, c.id, c.class_id, n_forms
FROM c JOIN (SELECT lang, class_id, count(DISTINCT form) AS n_forms FROM c JOIN l USING (lang, id) GROUP BY ALL) n USING (lang, class_id)
"""
# Brute force: every text of a language against every other.
SETS_SQL = CLASSES_SQL.format(labels="""t AS (
  SELECT lang, doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents),
s AS (SELECT lang, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [hash(w)]
                              ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: hash(w[i:i + {n} - 1])) END) AS x FROM t),
d AS (SELECT DISTINCT * FROM s),
l AS (SELECT t.lang, t.id, CASE WHEN count(x) = 0 THEN 'none' || t.id ELSE md5(list(x ORDER BY x)::VARCHAR) END AS form, count(x) AS n
      FROM (SELECT lang, id FROM t) t LEFT JOIN d ON d.lang = t.lang AND d.id = t.id GROUP BY t.lang, t.id)""", links="""
  SELECT a.lang, a.id AS a, b.id AS b FROM (
    SELECT p.lang, p.id AS x, q.id AS y, count(*) AS shared FROM d p JOIN d q ON p.lang = q.lang AND p.x = q.x AND p.id <> q.id GROUP BY ALL) m
  JOIN l a ON a.lang = m.lang AND a.id = x JOIN l b ON b.lang = m.lang AND b.id = y WHERE 5 * shared >= 4 * (a.n + b.n - shared)""")


@query(SETS_SQL.replace("{n}", "1"))
def near_word_sets(t: Tables) -> DataFrame:
    """Classes of whole documents that share four fifths of their words."""
    docs = t.documents.select("lang", "doc_id", "text")
    return near.near_texts(docs, ["lang"], "text", "doc_id", words=1)


@query(SETS_SQL.replace("{n}", "5"))
def near_shingles(t: Tables) -> DataFrame:
    """Classes of whole documents that share four fifths of their runs of five words."""
    return near.near_texts(t.documents.select("lang", "doc_id", "text"), ["lang"], "text", "doc_id")


@query(CLASSES_SQL.format(labels="""w AS (
  SELECT lang, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS term FROM documents),
l AS (SELECT lang, term AS id, term AS form FROM w GROUP BY ALL HAVING count(*) >= 10)""", links="""
  SELECT a.lang, a.id AS a, b.id AS b FROM l a JOIN l b ON a.lang = b.lang AND abs(len(a.id) - len(b.id)) <= 1
  WHERE CASE -- levenshtein counts bytes, so only ASCII is left to it
    WHEN strlen(a.id) = len(a.id) AND strlen(b.id) = len(b.id) THEN levenshtein(a.id, b.id) = 1
    WHEN len(a.id) = len(b.id) THEN len(list_filter(range(1, len(a.id) + 1), lambda i: substr(a.id, i, 1) <> substr(b.id, i, 1))) = 1
    WHEN len(a.id) > len(b.id) THEN list_contains(list_transform(range(1, len(a.id) + 1), lambda i: substr(a.id, 1, i - 1) || substr(a.id, i + 1)), b.id)
    ELSE list_contains(list_transform(range(1, len(b.id) + 1), lambda i: substr(b.id, 1, i - 1) || substr(b.id, i + 1)), a.id) END"""))
def near_terms(t: Tables) -> DataFrame:
    """The terms of a language in at least ten documents, in classes of one changed letter."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))
    terms = t.documents.select("lang", F.explode(words).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return near.near_spellings(terms.filter("n >= 10").select("lang", "term"), ["lang"], "term", "term")


@query("""
SELECT sha256(text) AS subject, count(DISTINCT source) AS n_chunks, count(*) AS n_evidence FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1
""")
def cross_chunk_subjects(t: Tables) -> DataFrame:
    evidence = t.documents.select(F.sha2("text", 256).alias("subject"), "source")
    return coverage.cross_chunk(evidence, ["subject"], "source")


@query("""
SELECT l_returnflag, l_linestatus, r_name, CAST(grouping(l_returnflag, l_linestatus, r_name) AS BIGINT) AS level, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY CUBE (l_returnflag, l_linestatus, r_name)
""")
def disposition_cube(t: Tables) -> DataFrame:
    """Lines by return flag, line status and region, counted per supplier before the joins."""
    dims = ["l_returnflag", "l_linestatus", "r_name"]
    supplier = (
        t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
        .join(t.nation, "n_nationkey")
        .join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
        .select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    )
    counted = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return coverage.disposition_cube(counted.join(supplier, "l_suppkey"), dims, weight="n")


@query("""
SELECT sha256(text) AS k, count(*) AS multiplicity, count(DISTINCT source) AS n_values, min(doc_id) AS first_position, max(doc_id) AS last_position,
       CASE WHEN count(DISTINCT source) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'identical' ELSE 'single' END AS status
FROM documents GROUP BY 1
""")
def canonicalize_dupes(t: Tables) -> DataFrame:
    """Texts as keys, their source as the value that must agree."""
    rows = t.documents.select(F.sha2("text", 256).alias("k"), F.sha2("source", 256).alias("v"), "doc_id")
    return coverage.canonicalize(rows, ["k"], "v", "doc_id")


@query("""
SELECT sha256(text) AS k, doc_id, CASE WHEN n > 1 THEN 'conflict' ELSE 'identical' END AS status
FROM documents JOIN (SELECT text, count(DISTINCT source) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) USING (text)
""")
def duplicate_positions(t: Tables) -> DataFrame:
    rows = t.documents.select(F.sha2("text", 256).alias("k"), F.sha2("source", 256).alias("v"), "doc_id")
    return coverage.occurrence_positions(rows, coverage.canonicalize(rows, ["k"], "v", "doc_id"), ["k"], "doc_id")


@query("SELECT sha256(text) AS question, source, count(*) AS n_tasks FROM documents GROUP BY 1, 2")
def consolidate_questions(t: Tables) -> DataFrame:
    tasks = t.documents.select(F.sha2("text", 256).alias("question"), "source")
    return coverage.consolidate(tasks, ["question"], "source")


@query("""
WITH m AS (SELECT DISTINCT o_custkey AS old_id, CAST(floor(o_totalprice) AS BIGINT) // 100 AS new_id FROM orders),
r AS (SELECT old_id, count(*) AS n_right FROM m GROUP BY 1), l AS (SELECT new_id, count(*) AS n_left FROM m GROUP BY 1)
SELECT old_id, new_id, n_right, n_left,
       CASE WHEN n_right = 1 AND n_left = 1 THEN 'equivalent' WHEN n_left = 1 THEN 'split' WHEN n_right = 1 THEN 'merge' ELSE 'changed_boundary' END AS shape
FROM m JOIN r USING (old_id) JOIN l USING (new_id)
""")
def crosswalk_shape(t: Tables) -> DataFrame:
    """Customers mapped to price bands."""
    mapping = t.orders.select(
        F.col("o_custkey").alias("old_id"), bucket_of(F.floor("o_totalprice"), 100).alias("new_id")
    )
    return coverage.crosswalk_shape(mapping, "old_id", "new_id")


@query("""
SELECT l_returnflag, count(DISTINCT l_partkey) AS unique_keys, count(DISTINCT l_suppkey) AS unique_destinations,
       count(DISTINCT (l_partkey, l_suppkey)) AS distinct_bindings, count(*) AS bindings FROM lineitem GROUP BY 1
""")
def mapping_counts(t: Tables) -> DataFrame:
    return coverage.mapping_counts(t.lineitem, ["l_returnflag"], "l_partkey", "l_suppkey")


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def entity_counts(t: Tables) -> DataFrame:
    return coverage.entity_counts(t.part, ["p_brand", "p_type"])


@query("""
WITH o AS (SELECT o_orderkey AS overlay_id, c_nationkey AS author_id, o_orderpriority = '1-URGENT' AS seen FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT l_orderkey AS overlay_id, min(s_nationkey) AS reviewer_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
d AS (SELECT DISTINCT l_orderkey AS overlay_id, l_partkey AS delta_id FROM lineitem WHERE l_linenumber <= 5),
v AS (SELECT DISTINCT l_orderkey AS overlay_id, l_partkey AS delta_id FROM lineitem WHERE l_linenumber >= 2),
g AS (SELECT overlay_id, count(*) FILTER (v.x IS NULL) AS n_unreviewed, count(*) FILTER (d.x IS NULL) AS n_unknown
      FROM (SELECT *, 1 AS x FROM d) d FULL JOIN (SELECT *, 1 AS x FROM v) v USING (overlay_id, delta_id) GROUP BY 1),
e AS (SELECT overlay_id, coalesce(author_id <> reviewer_id, false) AS other_reviewer, NOT seen AND reviewer_id IS NOT NULL AS unexposed,
             coalesce(n_unreviewed, 0) AS n_unreviewed, coalesce(n_unknown, 0) AS n_unknown FROM o LEFT JOIN r USING (overlay_id) LEFT JOIN g USING (overlay_id))
SELECT *, other_reviewer AND unexposed AND n_unreviewed = 0 AND n_unknown = 0 AS ok FROM e
""")
def independence(t: Tables) -> DataFrame:
    """Orders as overlays: their customer's nation is the author, a supplier's nation reviews."""
    overlays = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("overlay_id"), F.col("c_nationkey").alias("author_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("candidate_seen"),
    )
    lines = t.lineitem.select(F.col("l_orderkey").alias("overlay_id"), F.col("l_partkey").alias("delta_id"), "l_suppkey", "l_linenumber")
    reviews = lines.select("overlay_id", "l_suppkey").distinct().join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("overlay_id").agg(
        F.min("s_nationkey").alias("reviewer_id"), F.lit(False).alias("candidate_seen")
    )
    return coverage.independence(
        overlays, reviews, lines.filter("l_linenumber <= 5"), lines.filter("l_linenumber >= 2")
    )


@query("""
WITH rules AS (SELECT * FROM (VALUES ('signup', 'purchase'), ('view', 'click')) v(prerequisite, dependent)),
f AS (SELECT user_id, event_type AS prerequisite, min(ts) AS ready FROM events GROUP BY 1, 2)
SELECT e.user_id, e.event_id, e.event_type AS kind, r.prerequisite, CASE WHEN ready IS NULL THEN 'no_prerequisite' ELSE 'too_early' END AS problem
FROM events e JOIN rules r ON e.event_type = r.dependent LEFT JOIN f ON e.user_id = f.user_id AND f.prerequisite = r.prerequisite
WHERE ready IS NULL OR e.ts <= ready
""")
def chronology(t: Tables) -> DataFrame:
    """Purchases must follow a signup and clicks a view."""
    rules = {"purchase": ["signup"], "click": ["view"]}
    events = t.events.select("user_id", "event_id", "ts", F.col("event_type").alias("kind"))
    return coverage.chronology(events, rules, ["user_id"])


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber AS step, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, step FROM s WHERE EXISTS (SELECT 1 FROM s e WHERE e.l_orderkey = s.l_orderkey AND e.step < s.step AND s.a < e.b)
""")
def sequence_breaks(t: Tables) -> DataFrame:
    """Lines of an order shipped before some line ahead of them."""
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("step"), "l_shipdate")
    return coverage.sequence_breaks(lines, ["l_orderkey"], "step", "l_shipdate")


@query("""
SELECT d.user_id, d.event_id, d.event_type AS kind, p.event_type AS prerequisite, p.event_id AS ready_id, p.ts AS ready_at
FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'signup' ELSE 'view' END AS need FROM events WHERE event_type IN ('purchase', 'click')) d
ASOF JOIN events p ON d.user_id = p.user_id AND d.need = p.event_type AND d.ts > p.ts
UNION ALL
SELECT user_id, event_id, event_type, CASE event_type WHEN 'purchase' THEN 'signup' ELSE 'view' END, NULL, NULL FROM events d
WHERE event_type IN ('purchase', 'click') AND NOT EXISTS (
  SELECT 1 FROM events p WHERE p.user_id = d.user_id AND p.ts < d.ts AND p.event_type = CASE d.event_type WHEN 'purchase' THEN 'signup' ELSE 'view' END)
""")
def latest_prerequisite(t: Tables) -> DataFrame:
    """The last signup before each purchase and the last view before each click."""
    rules = {"purchase": ["signup"], "click": ["view"]}
    events = t.events.select("user_id", "event_id", "ts", F.col("event_type").alias("kind"))
    return coverage.latest_prerequisite(events, rules, ["user_id"])


# Orders as ranges of a line of 10^14 places: a day has 10^9, an order takes its price in millions.
RANGES_SQL = """
r AS (SELECT o_custkey AS k, CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 1000000000 AS lo,
             CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 1000000000 + CAST(floor(o_totalprice) AS BIGINT) * 1000000 - 1 AS hi FROM orders),
w AS (SELECT k, min(lo) + 5000000000 AS lo, max(lo) AS hi FROM r GROUP BY k),
p AS (SELECT k, lo AS p FROM r UNION SELECT k, hi + 1 FROM r UNION SELECT k, lo FROM w WHERE lo <= hi UNION SELECT k, hi + 1 FROM w WHERE lo <= hi),
s AS (SELECT k, p AS first, lead(p) OVER (PARTITION BY k ORDER BY p) - 1 AS last FROM p),
c AS (
  SELECT s.k, first, last, (SELECT count(*) FROM r WHERE r.k = s.k AND r.lo <= first AND last <= r.hi) AS depth,
         (SELECT count(*) FROM w WHERE w.k = s.k AND w.lo <= first AND last <= w.hi) AS expected
  FROM s WHERE last IS NOT NULL)
"""


def order_ranges(t: Tables) -> tuple[DataFrame, DataFrame]:
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("bigint")
    lo = day * 1_000_000_000
    ranges = t.orders.select(F.col("o_custkey").alias("k"), lo.alias("lo"), (lo + F.floor("o_totalprice").cast("bigint") * 1_000_000 - 1).alias("hi"))
    whole = ranges.groupBy("k").agg((F.min("lo") + 5_000_000_000).alias("lo"), F.max("lo").alias("hi"))
    return ranges, whole


@query("WITH " + RANGES_SQL + """,
m AS (SELECT *, count(*) FILTER (depth <> d OR expected <> e OR d IS NULL) OVER (PARTITION BY k ORDER BY first) AS run
      FROM (SELECT *, lag(depth) OVER (PARTITION BY k ORDER BY first) AS d, lag(expected) OVER (PARTITION BY k ORDER BY first) AS e FROM c)),
g AS (SELECT k, run, min(first) AS first, max(last) AS last, any_value(depth) AS depth, any_value(expected) AS expected FROM m GROUP BY k, run)
SELECT k, first, last, depth, CASE WHEN expected = 0 THEN 'outside' WHEN depth = 0 THEN 'gap' ELSE 'overlap' END AS problem
FROM g WHERE (expected = 0 AND depth > 0) OR (expected > 0 AND depth <> 1)
""")
def interval_coverage(t: Tables) -> DataFrame:
    """Stretches of a customer's time that no order or several orders take."""
    return intervals.interval_coverage(*order_ranges(t), ["k"], "lo", "hi")


@query("WITH " + RANGES_SQL + """
SELECT k, CAST(sum(last - first + 1) AS BIGINT) AS n_pages, CAST(coalesce(sum(last - first + 1) FILTER (depth > 0), 0) AS BIGINT) AS n_inspected,
       CAST(coalesce(sum(last - first + 1) FILTER (depth = 0), 0) AS BIGINT) AS n_open, min(first) FILTER (depth = 0) AS next_page,
       count(*) FILTER (depth = 0) = 0 AS complete
FROM c WHERE expected > 0 GROUP BY k
""")
def interval_progress(t: Tables) -> DataFrame:
    """How much of a customer's time orders take."""
    return intervals.interval_progress(*order_ranges(t), ["k"], "lo", "hi")

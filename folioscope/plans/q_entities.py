"""Queries: sources and sinks, dataset documents as entity tables, and check reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.canonical import canonical_sha
from folioscope.operators import checks
from folioscope.plans.registry import Tables, query
from folioscope.session import shared_folder
from folioscope.sources import publish, readers, writers
from folioscope.sources.entities import explode_entities, explode_releases


def order_documents(t: Tables) -> DataFrame:
    """One small dataset document per order, written as JSON and parsed again."""
    key = F.col("o_orderkey")
    evidence = F.transform(
        F.sequence(F.lit(0), (key % 3).cast("int")),
        lambda i: F.struct(F.concat(F.lit("E"), i).alias("evidence_id"), (key + i).alias("document_page")),
    )
    doc = F.struct(
        F.array(F.struct(F.concat(F.lit("S"), "o_custkey").alias("subject_id"), evidence.alias("evidence"))).alias("subjects"),
        F.array(F.struct(
            F.concat(F.lit("T"), key).alias("task_id"),
            F.array(F.struct(F.col("o_orderpriority").alias("facet_id"))).alias("required_access_facets"),
        )).alias("reader_tasks"),
    )
    return t.orders.select(
        F.concat_ws("/", F.lit("v1"), "o_orderkey").alias("version"), F.parse_json(F.to_json(doc)).alias("doc")
    )


@query("""
WITH e AS (SELECT 'v1/' || o_orderkey AS version, 'S' || o_custkey AS parent_id, unnest(range(0, o_orderkey % 3 + 1)) AS pos FROM orders)
SELECT 'subjects.evidence' AS tbl, version, parent_id, 'E' || pos AS id, CAST(pos AS INTEGER) AS pos FROM e
UNION ALL SELECT 'reader_tasks.required_access_facets', 'v1/' || o_orderkey, 'T' || o_orderkey, o_orderpriority, 0 FROM orders
""")
def entity_tables(t: Tables) -> DataFrame:
    """Nested records with their parent and position."""
    tables = explode_entities(order_documents(t))
    nested = [
        tables[name].select(F.lit(name).alias("tbl"), "version", "parent_id", "id", "pos")
        for name in ("subjects.evidence", "reader_tasks.required_access_facets")
    ]
    return nested[0].unionByName(nested[1])


@query("""
SELECT 'R' || o_orderkey AS release_id, CASE o_orderkey % 2 WHEN 0 THEN 'state' ELSE NULL END AS role, 'data/' || o_custkey AS path, o_orderpriority AS sha256 FROM orders
""")
def release_bindings(t: Tables) -> DataFrame:
    """Release descriptors as bindings: even orders bind by role, odd ones as evidence."""
    binding = F.struct(F.concat(F.lit("data/"), "o_custkey").alias("path"), F.col("o_orderpriority").alias("sha256"))
    even = F.col("o_orderkey") % 2 == 0
    doc = F.struct(
        F.concat(F.lit("R"), "o_orderkey").alias("release_id"),
        F.when(even, F.create_map(F.lit("state"), binding)).alias("artifacts"),
        F.when(~even, F.array(binding)).alias("evidence"),
    )
    docs = t.orders.select(F.col("o_orderkey").cast("string").alias("path"), F.to_json(doc).alias("json"))
    return explode_releases(docs)["bindings"].drop("descriptor")


@query("""
SELECT 'order_has_lines' AS "check", count(*) AS n_checks, count(*) FILTER (n = 0) AS n_failed, bool_and(n > 0) AS ok
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
UNION ALL SELECT 'price_positive', count(*), count(*) FILTER (NOT o_totalprice > 0), bool_and(o_totalprice > 0) FROM orders
""")
def check_report(t: Tables) -> DataFrame:
    """Two kinds of check rows and their verdicts."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    counted = t.orders.join(lines, "o_orderkey", "left")
    rows = checks.all_checks([
        checks.check_rows(counted, "order_has_lines", F.col("o_orderkey"), F.col("n") > 0, F.col("n")),
        checks.check_rows(t.orders, "price_positive", F.col("o_orderkey"), F.col("o_totalprice") > 0, F.col("o_totalprice")),
    ])
    return checks.verdict(rows, ["check"])


@query("""
SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'not a JSON object' ELSE 'ok' END AS status,
       CASE WHEN event_id % 4 IN (0, 3) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events
""")
def json_documents(t: Tables) -> DataFrame:
    """Event properties as documents, a quarter of them cut short and a quarter put into a list."""
    turn = F.col("event_id") % 4
    text = F.when(turn == 1, F.expr("substring(props, 1, length(props) - 1)")).when(
        turn == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    good, bad = readers.split_documents(t.events.select("event_id", text.alias("json")))
    return good.select("event_id", F.lit("ok").alias("status"), F.try_variant_get("doc", "$.k", "bigint").alias("k")).unionByName(
        bad.select("event_id", F.col("reason").alias("status"), F.lit(None).cast("bigint").alias("k")))


@query("""
SELECT 'O' || o_orderkey AS id, '/status' AS pointer, 'replace' AS op, 'null' AS before, '"' || o_orderstatus || '"' AS after FROM orders
UNION ALL SELECT 'O' || o_orderkey, '/lines', 'add', NULL, '[' || o_custkey || ',{"k":' || o_orderkey || '}]' FROM orders
""")
def ledger_rows(t: Tables) -> DataFrame:
    """Orders as lines of a review ledger: a JSON null before, and a value that was not there."""
    line = F.concat(
        F.lit('{"id":"O'), "o_orderkey", F.lit('","before_file":"f","field_diffs":[{"path":"/status","operation":"replace","before":null,"after":"'),
        "o_orderstatus", F.lit('"},{"path":"/lines","operation":"add","after":[ '), "o_custkey", F.lit(', {"k": '), "o_orderkey", F.lit("}]}]}"))
    ledger = readers.parse_ledger(t.orders.select(line.alias("line")), "line")
    return readers.ledger_changes(ledger).select("id", "pointer", "op", "before", "after")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) AS word FROM l)
SELECT doc_id AS source_id, CAST(doc_id % 3 + 1 AS INTEGER) AS page, count(*) AS n_words, count(DISTINCT n) AS n_lines, CAST(sum(len(word)) AS BIGINT) AS n_chars,
       max(10.0::DOUBLE * (n + 1)) AS lowest FROM w GROUP BY ALL
""")
def layout_words(t: Tables) -> DataFrame:
    """Documents as bounding-box pages: lines with a height, words with theirs."""
    def word(w):
        safe = F.replace(F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat(F.lit('<word yMin="1" yMax="2">'), safe, F.lit("</word>"))

    def line(x, i):
        words = F.transform(F.filter(F.split(x, " "), lambda w: w != ""), word)
        return F.concat(F.lit('<line yMin="'), ((i + 1) * 10).cast("string"), F.lit('" yMax="0">'), F.array_join(words, ""), F.lit("</line>"))

    xml = F.concat(F.lit("<page><flow><block>"), F.array_join(F.transform(F.split("text", "\n"), line), ""), F.lit("</block></flow></page>"))
    pages = t.documents.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("page"), xml.alias("xml"))
    words = readers.layout_from_xml(pages, "xml")
    by_line = words.groupBy("source_id", "page", "line_no").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.max("line_y_min").alias("y"))
    return by_line.groupBy("source_id", "page").agg(
        F.sum("n").cast("bigint").alias("n_words"), F.count("*").alias("n_lines"), F.sum("c").cast("bigint").alias("n_chars"), F.max("y").alias("lowest"))


@query("""
SELECT r_name AS stage_of, n AS n_rows, sha FROM (
  SELECT 'first' AS r_name, count(*) AS n, min(sha256('{"k":' || c_custkey || ',"n":' || c_nationkey || '}')) AS sha FROM customer
  UNION ALL SELECT 'second', count(*) FILTER (c_custkey % 2 = 0), min(sha256('{"k":' || c_custkey || ',"n":' || c_nationkey || '}')) FILTER (c_custkey % 2 = 0) FROM customer)
""")
def published_stages(t: Tables) -> DataFrame:
    """Two stages are published; a second try of each fails its checks and stays unseen."""
    path = f"{shared_folder(t.spark)}/published-{uuid.uuid4().hex}"
    record = F.concat(F.lit('{ "n": '), "c_nationkey", F.lit(', "k": '), "c_custkey", F.lit("}"))
    first = t.customer.select("c_custkey", canonical_sha(record).alias("sha"))

    def whole(rows: DataFrame) -> DataFrame:
        return checks.check_rows(rows, "has_digest", F.col("c_custkey"), F.length("sha") == 64, F.col("sha"))

    publish.publish(first, path, 0, whole)
    publish.publish(first.withColumn("sha", F.when(F.col("c_custkey") % 7 != 0, F.col("sha"))), path, 0, whole)
    seen = publish.read_stage(t.spark, path, 0)
    publish.publish(seen.filter("c_custkey % 2 = 0"), path, 1, whole)
    publish.publish(seen.filter("c_custkey % 2 = 1"), path, 1, lambda rows: whole(rows).filter("false"))
    stages = [publish.read_stage(t.spark, path, i).agg(F.count("*").alias("n_rows"), F.min("sha").alias("sha")) for i in (0, 1)]
    return stages[0].select(F.lit("first").alias("stage_of"), "n_rows", "sha").unionByName(
        stages[1].select(F.lit("second").alias("stage_of"), "n_rows", "sha"))


@query("""
SELECT n_nationkey AS source_id, sum(n) AS words, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS chunk_words
FROM (SELECT n_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1
""".replace("sum(n) AS words", "CAST(sum(n) AS BIGINT) AS words"))
def written_measurement(t: Tables) -> DataFrame:
    """A measurement report written to the shared folder and read back."""
    path = f"{shared_folder(t.spark)}/measured-{uuid.uuid4().hex}"
    chunks = t.customer.groupBy(F.col("c_nationkey").alias("source_id"), F.col("c_mktsegment").alias("chunk_id")).agg(F.count("*").alias("words"))
    writers.write_measurement(t.customer.select(F.col("c_nationkey").alias("source_id"), "c_custkey"), chunks, t.nation, path)
    read = lambda name: t.spark.read.parquet(f"{path}/{name}")
    again = read("chunks").groupBy("source_id").agg(F.sum("words").alias("chunk_words"))
    return read("totals").join(again, "source_id")

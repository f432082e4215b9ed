"""Queries: page maps, chunk ownership and text measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.numbers import bucket_of
from folioscope.functions.ranking import bucketed_position
from folioscope.operators import diff, measure, pages
from folioscope.plans.registry import Tables, query

PAGES_PER_CHUNK = 10
# Document ids count up from 0, so two levels of buckets leave one row for each 2**32 of them.
DENSE = 2
# Text of one task of words: as positioned words it takes about thirty times as much memory.
PART_BYTES = 4 << 20


def texts(t: Tables, *columns: str) -> DataFrame:
    """Document texts with the named columns."""
    return t.documents.select("doc_id", "text", *columns)


def ranked_documents(t: Tables) -> DataFrame:
    """(source_id, page, doc_id): documents of a source are its pages in id order."""
    ids = t.documents.select(F.col("source").alias("source_id"), "doc_id")
    return bucketed_position(ids, ["source_id"], "doc_id", "page", levels=DENSE)


def chunks_of(ranked: DataFrame) -> DataFrame:
    """Chunks of ten pages with up to two context pages on each side."""
    number = bucket_of(F.col("page") - 1, PAGES_PER_CHUNK)
    spans = ranked.groupBy("source_id", number.alias("packet_order")).agg(
        F.min("page").alias("lo"), F.max("page").alias("hi")
    )
    before = F.when(
        F.col("lo") > 1, F.array(F.greatest(F.lit(1), F.col("lo") - 2), F.col("lo") - 1)
    )
    return spans.select(
        "source_id", F.concat(F.lit("CHUNK-"), F.col("packet_order")).alias("chunk_id"), "packet_order",
        F.array(F.array("lo", "hi")).alias("owned_ranges"),
        F.array_compact(F.array(before)).alias("context_ranges"),
    )


@query("""
WITH p AS (
  SELECT source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page,
         len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS words
  FROM documents)
SELECT source_id, CASE WHEN grouping(chunk_id) = 0 THEN chunk_id END AS chunk_id,
       CASE WHEN grouping(source_id) = 1 THEN 'all' WHEN grouping(chunk_id) = 1 THEN 'source' ELSE 'chunk' END AS level,
       count(*) AS pages, CAST(sum(words) AS BIGINT) AS words
FROM (SELECT source_id, 'CHUNK-' || ((page - 1) // 10) AS chunk_id, words FROM p)
GROUP BY ROLLUP (source_id, chunk_id)
""")
def words_by_chunk(t: Tables) -> DataFrame:
    """Counts are taken where the text is read; only ids and numbers are moved."""
    counted = texts(t, "source").select(
        F.col("source").alias("source_id"), "doc_id",
        tx.count_tokens(tx.dehyphenate(F.col("text"))).alias("words"),
    )
    ranked = bucketed_position(counted, ["source_id"], "doc_id", "page", levels=DENSE)
    number = bucket_of(F.col("page") - 1, PAGES_PER_CHUNK)
    return measure.rollup_owned(ranked.withColumn("chunk_id", F.concat(F.lit("CHUNK-"), number)))


@query("""
WITH p AS (
  SELECT source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, len(regexp_extract_all(text, '[^\\s]+')) AS words FROM documents),
c AS (SELECT source_id, (page - 1) // 10 AS n, min(page) AS lo, max(page) AS hi FROM p WHERE page % 7 <> 3 GROUP BY ALL),
o AS (SELECT p.source_id, 'CHUNK-' || n AS chunk_id, p.words FROM p JOIN c ON p.source_id = c.source_id AND p.page BETWEEN lo AND hi)
SELECT source_id, CASE WHEN grouping(chunk_id) = 0 THEN chunk_id END AS chunk_id,
       CASE WHEN grouping(source_id) = 1 THEN 'all' WHEN grouping(chunk_id) = 1 THEN 'source' ELSE 'chunk' END AS level,
       count(*) AS pages, CAST(sum(words) AS BIGINT) AS words
FROM o GROUP BY ROLLUP (source_id, chunk_id)
""")
def words_rolled_up(t: Tables) -> DataFrame:
    """Pages meet the chunks that own them; chunks end at pages of a smaller map, so some pages have none."""
    counted = t.documents.select(F.col("source").alias("source_id"), "doc_id", F.regexp_count("text", F.lit(r"[^\s]+")).cast("bigint").alias("words"))
    numbered = bucketed_position(counted, ["source_id"], "doc_id", "page", levels=DENSE)
    chunk_pages = pages.expand_chunks(chunks_of(numbered.filter("page % 7 <> 3").select("source_id", "page")))
    return measure.rollup_words(numbered, chunk_pages)


LINES_SQL = """
lines AS (
  SELECT d.doc_id AS page, d.source AS source_id, l.line_no, 40 + 12 * l.line_no AS y, l.line,
         len(string_split(l.line, ' ')) AS n_words,
         d.doc_id % 10 = 1 AS is_start, d.doc_id % 25 = 0 AS is_special
  FROM documents d, (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) l
  WHERE d.doc_id = l.doc_id)
"""


def document_lines(t: Tables) -> DataFrame:
    """Lines of documents with derived geometry; every 25th page is special."""
    lines = texts(t, "source").select(
        F.col("doc_id").alias("page"), F.col("source").alias("source_id"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    return lines.withColumns({
        "y": (F.lit(40) + F.col("line_no") * 12).cast("double"),
        "n_words": F.size(F.split("line", " ")),
        "is_start": F.col("page") % 10 == 1, "is_special": F.col("page") % 25 == 0,
    })


CAPTION_RULES = "array(named_struct('y_lo', 60d, 'y_hi', 100d, 'prefix', cast(null as string)), " \
    "named_struct('y_lo', cast(null as double), 'y_hi', cast(null as double), 'prefix', 'The '))"


@query("WITH " + LINES_SQL + """
SELECT source_id, coalesce(reason, 'kept') AS reason, count(*) AS n_lines, CAST(sum(n_words) AS BIGINT) AS n_tokens
FROM (SELECT *, CASE WHEN is_special THEN CASE WHEN NOT ((y > 60 AND y < 100) OR starts_with(line, 'The ')) THEN 'map_internals_key_or_source_credit' END
                     WHEN is_start AND y < 170 THEN 'chapter_display'
                     WHEN y < 50 THEN 'running_furniture' END AS reason FROM lines)
GROUP BY 1, 2
""")
def line_roles(t: Tables) -> DataFrame:
    lines = document_lines(t)
    caption = measure.is_caption(F.expr(CAPTION_RULES), F.col("y"), F.col("line"))
    reason = measure.line_reason(
        F.col("is_special"), F.col("is_start"), F.col("y"), F.lit(measure.DISPLAY_Y), caption
    )
    return lines.groupBy("source_id", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n_lines"), F.sum("n_words").cast("bigint").alias("n_tokens")
    )


@query("WITH " + LINES_SQL + """
SELECT page, line_no::INTEGER AS line_no,
       sha256(regexp_replace(line, '^Map\\s+[0-9]+\\.\\s*', '')) AS label_sha
FROM (SELECT page, line_no, y, is_special, 'Map ' || line_no || '. ' || line AS line FROM lines)
WHERE is_special AND ((y > 60 AND y < 100) OR starts_with(line, 'Map 1'))
""")
def caption_lines(t: Tables) -> DataFrame:
    """Captions of special pages after their number label is stripped."""
    lines = document_lines(t).filter("is_special").withColumn(
        "line", F.concat(F.lit("Map "), F.col("line_no"), F.lit(". "), F.col("line"))
    )
    rules = F.expr(CAPTION_RULES.replace("'The '", "'Map 1'"))
    kept = lines.filter(measure.is_caption(rules, F.col("y"), F.col("line")))
    return kept.select("page", "line_no", F.sha2(tx.strip_caption_label(F.col("line")), 256).alias("label_sha"))


@query("""
SELECT lang, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(dropped) AS BIGINT) AS n_callouts
FROM (SELECT lang, len(string_split(text, ' ')) AS n,
             CASE WHEN doc_id % 25 = 0 THEN 0 ELSE len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[0-9]+$') AND len(w) <= 3)) END AS dropped
      FROM documents)
GROUP BY lang
""")
def callouts_dropped(t: Tables) -> DataFrame:
    """Digit words of small height are note calls, except on special pages."""
    words = F.split("text", " ")
    height = lambda w: F.when(F.length(w) <= 3, 7.9).otherwise(8.0)
    dropped = F.size(F.filter(words, lambda w: measure.is_callout(w, height(w), F.col("doc_id") % 25 == 0)))
    return texts(t, "lang").select("lang", F.size(words).alias("n"), dropped.alias("dropped")).groupBy("lang").agg(
        F.count("*").alias("n_pages"), F.sum("n").cast("bigint").alias("n_words"),
        F.sum("dropped").cast("bigint").alias("n_callouts"),
    )


@query("""
WITH broken AS (
  SELECT doc_id, text, regexp_replace(text, '(\\p{L}{4})(\\p{L}{3})', '\\1-\n  \\2', 'g') AS wrapped FROM documents),
joined AS (
  SELECT *, regexp_replace(regexp_replace(wrapped, '([\\p{L}\\p{Nl}\\p{No}])[-\u00ad]\\s*\\n\\s*([\\p{L}\\p{Nl}\\p{No}])', '\\1\\2', 'g'),
            '([\\p{L}\\p{Nl}\\p{No}])[-\u00ad]\\s*\\n\\s*([\\p{L}\\p{Nl}\\p{No}])', '\\1\\2', 'g') AS back FROM broken)
SELECT doc_id, wrapped <> text AS was_wrapped, back = text AS restored, sha256(back) AS sha,
       CAST(len(list_filter(string_split_regex(back, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS BIGINT) AS words
FROM joined
""")
def dehyphenated(t: Tables) -> DataFrame:
    """Words broken over lines by a rule come back whole."""
    wrapped = F.regexp_replace("text", r"(\p{L}{4})(\p{L}{3})", "$1-\n  $2")
    joined = texts(t).select("doc_id", "text", wrapped.alias("wrapped")).withColumn(
        "back", tx.dehyphenate(F.col("wrapped"))
    )
    return joined.select(
        "doc_id", (F.col("wrapped") != F.col("text")).alias("was_wrapped"),
        (F.col("back") == F.col("text")).alias("restored"), F.sha2("back", 256).alias("sha"),
        tx.count_tokens(F.col("back")).alias("words"),
    )


@query("""
WITH p AS (
  SELECT source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page,
         CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^\\p{L}]+$', '') || '-' ELSE text END AS text FROM documents),
f AS (
  SELECT source_id, page, page % 10 = 1 AS is_start, page % 25 = 0 AS is_special,
         regexp_matches(text, '^\\s*[\\p{L}\\p{Nl}\\p{No}]') AS opens,
         regexp_matches(text, '[\\p{L}\\p{Nl}\\p{No}][-\u00ad]\\s*$') AS hangs FROM p)
SELECT source_id, prev AS starts_on_page, page AS continues_on_page, prev AS word_assigned_to_page
FROM (SELECT *, lag(page) OVER w AS prev, lag(hangs) OVER w AS prev_hangs, lag(is_special) OVER w AS prev_special
      FROM f WINDOW w AS (PARTITION BY source_id ORDER BY page))
WHERE prev_hangs AND NOT prev_special AND opens AND NOT is_start AND NOT is_special
""")
def cross_page_joins(t: Tables) -> DataFrame:
    """Every third page is cut inside its last word, to be finished on the next page."""
    cut = F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.regexp_replace("text", r"[^\p{L}]+$", ""), F.lit("-"))
    ).otherwise(F.col("text"))
    edges = measure.page_edges(texts(t, "source").select(
        F.col("source").alias("source_id"), "doc_id", cut.alias("text"), F.lit(0).cast("bigint").alias("words"),
    ))
    ranked = bucketed_position(edges, ["source_id"], "doc_id", "page").withColumns({
        "is_start": F.col("page") % 10 == 1, "is_special": F.col("page") % 25 == 0,
    })
    return measure.cross_page_joins(ranked)[1]


@query("""
SELECT lang, count(*) AS n_docs, count(*) FILTER (contains(text, 'fi')) AS n_changed,
       count(*) AS n_restored,
       CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')))) AS BIGINT) AS words
FROM documents GROUP BY lang
""")
def nfkc_words(t: Tables) -> DataFrame:
    """Texts written with ligatures come back in plain letters."""
    docs = texts(t, "lang").select("lang", "text", F.replace(F.col("text"), F.lit("fi"), F.lit("\ufb01")).alias("typeset"))
    docs = docs.withColumn("plain", tx.nfkc(F.col("typeset")))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("typeset") != F.col("plain")).alias("n_changed"),
        F.count_if(F.col("plain") == F.col("text")).alias("n_restored"),
        F.sum(tx.count_tokens(F.col("plain"))).cast("bigint").alias("words"),
    )


def word_parts(t: Tables) -> int:
    """Tasks that words are dealt to, in proportion to the text."""
    total = t.documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def document_words(t: Tables, parts: int) -> DataFrame:
    """Documents laid out as positioned words: the input of the whole pipeline.

    Pages are placed by (source_id, page) before they become words, so that the
    pipeline finds its words in place, in ``parts`` tasks, and moves none of them.
    Every third page ends inside a word; digit words of up to three digits are
    small enough to be note calls.
    """
    cut = F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.regexp_replace("text", r"[^\p{L}]+$", ""), F.lit("-"))
    ).otherwise(F.col("text"))
    paged = texts(t).select("doc_id", cut.alias("text")).join(ranked_documents(t), "doc_id")
    paged = paged.repartition(parts, "source_id", "page")
    lines = paged.select("source_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select(
        "source_id", "page", "line_no", (F.lit(40) + F.col("line_no") * 12).cast("double").alias("line_y_min"),
        F.posexplode(F.split("line", " ")).alias("word_no", "text"),
    )
    height = F.when(F.length("text") <= 3, 7.5).otherwise(8.0)
    return words.withColumn("y_min", F.col("line_y_min")).withColumn("y_max", F.col("line_y_min") + height)


def document_rules(ranked: DataFrame) -> DataFrame:
    """Page rules as ``page_rules`` returns them, written down per page without a join."""
    page = F.col("page")
    special = page % 25 == 0
    return ranked.select(
        "source_id", "page", (page % 10 == 1).alias("is_start"), special.alias("is_special"),
        F.when(special, F.expr(CAPTION_RULES)).alias("captions"),
        F.when(page % 50 == 11, 210.0).otherwise(measure.DISPLAY_Y).alias("display_y"),
    ).filter("is_start or is_special")


def measured_documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    parts = word_parts(t)
    lines = measure.assemble_lines(document_words(t, parts), document_rules(ranked_documents(t)), parts)
    return measure.cross_page_joins(measure.page_edges(measure.assemble_pages(lines)))


MEASURED_SQL = """
WITH p AS (
  SELECT source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page,
         string_split(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^\\p{L}]+$', '') || '-' ELSE text END, chr(10)) AS ls FROM documents),
l AS (
  SELECT source_id, page, page % 10 = 1 AS is_start, page % 25 = 0 AS is_special,
         CASE WHEN page % 50 = 11 THEN 210 ELSE 170 END AS display_y, n AS line_no, ls[n + 1] AS raw, 40 + 12 * n AS y
  FROM p, unnest(range(len(ls))) AS u(n)),
r AS (
  SELECT *, string_split(raw, ' ') AS ws,
         CASE WHEN is_special THEN CASE WHEN NOT ((y > 60 AND y < 100) OR starts_with(raw, 'The ')) THEN 'map_internals_key_or_source_credit' END
              WHEN is_start AND y < display_y THEN 'chapter_display'
              WHEN y < 50 THEN 'running_furniture' END AS reason FROM l),
k AS (
  SELECT *, CASE WHEN is_special THEN ws ELSE list_filter(ws, lambda w: NOT (regexp_matches(w, '^[0-9]+$') AND len(w) <= 3)) END AS kept FROM r),
g AS (
  SELECT source_id, page, is_start, is_special,
         string_agg(CASE WHEN is_special THEN regexp_replace(array_to_string(kept, ' '), '^Map\\s+[0-9]+\\.\\s*', '') ELSE array_to_string(kept, ' ') END, chr(10) ORDER BY line_no)
           FILTER (reason IS NULL) AS text,
         CAST(coalesce(sum(len(ws)) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS n_excluded,
         CAST(coalesce(sum(len(ws) - len(kept)) FILTER (reason IS NULL), 0) AS BIGINT) AS n_callouts
  FROM k GROUP BY ALL),
c AS (
  SELECT *, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS words,
         regexp_matches(coalesce(text, ''), '^\\s*[\\p{L}\\p{Nl}\\p{No}]') AS opens,
         regexp_matches(coalesce(text, ''), '[\\p{L}\\p{Nl}\\p{No}][-\u00ad]\\s*$') AS hangs FROM g),
j AS (
  SELECT *, coalesce(lag(hangs AND NOT is_special) OVER w, false) AND opens AND NOT is_start AND NOT is_special AS joined
  FROM c WINDOW w AS (PARTITION BY source_id ORDER BY page)),
measured AS (
  SELECT source_id, page, CAST(words - CASE WHEN joined THEN 1 ELSE 0 END AS BIGINT) AS words, joined, n_excluded, n_callouts,
         CASE WHEN is_special THEN 'substantive_map_caption_only' ELSE 'body_and_substantive_notes' END AS role FROM j)
"""


@query(MEASURED_SQL + "SELECT source_id, page, words, role, n_excluded, n_callouts FROM measured")
def measured_pages(t: Tables) -> DataFrame:
    """The whole pipeline: positioned words to counted pages."""
    counted, _ = measured_documents(t)
    n = F.aggregate(F.map_values("excluded"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    callouts = F.coalesce(F.try_element_at("excluded", F.lit(measure.NOTE_CALLOUT)), F.lit(0))
    return counted.select(
        "source_id", "page", "words", "role", (n - callouts).alias("n_excluded"), callouts.cast("bigint").alias("n_callouts")
    )


@query(MEASURED_SQL + """
SELECT "check", source_id AS scope, ok, CAST(detail AS VARCHAR) AS detail FROM (
  SELECT source_id, 'page_words_positive' AS "check", min(words) > 0 AS ok, min(words) AS detail FROM measured GROUP BY 1
  UNION ALL
  SELECT source_id, 'chunk_sum_equals_page_sum', true, 0 FROM measured GROUP BY 1)
""")
def measurement_checks(t: Tables) -> DataFrame:
    counted, _ = measured_documents(t)
    chunk_pages = pages.expand_chunks(chunks_of(ranked_documents(t)))
    return measure.measurement_checks(counted, chunk_pages)


@query("""
WITH m AS (
  SELECT source AS source_id, 'CHUNK-' || (doc_id // 200) AS chunk_id,
         len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS uniform,
         len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS legacy,
         len(regexp_extract_all(text, '\\p{L}+')) AS native
  FROM documents)
SELECT source_id, chunk_id, CAST(sum(uniform) AS BIGINT) AS uniform, CAST(sum(legacy) AS BIGINT) AS legacy, CAST(sum(native) AS BIGINT) AS native,
       CAST(sum(legacy) - sum(uniform) AS BIGINT) AS legacy_minus_uniform, CAST(sum(native) - sum(uniform) AS BIGINT) AS native_minus_uniform
FROM m GROUP BY 1, 2
""")
def protocol_compare(t: Tables) -> DataFrame:
    """Three token rules side by side per chunk."""
    text = F.col("text")
    counts = F.array(
        F.struct(F.lit("uniform").alias("protocol"), tx.count_tokens(text).alias("words")),
        F.struct(F.lit("legacy").alias("protocol"), F.regexp_count(text, F.lit("[^ ]+")).cast("bigint").alias("words")),
        F.struct(F.lit("native").alias("protocol"), F.regexp_count(text, F.lit(r"\p{L}+")).cast("bigint").alias("words")),
    )
    measures = texts(t, "source").select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("CHUNK-"), bucket_of(F.col("doc_id"), 200)).alias("chunk_id"),
        F.inline(counts),
    )
    return measure.compare_protocols(measures, ["uniform", "legacy", "native"], "uniform")


@query("""
WITH w AS (
  SELECT source, lang, doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS words FROM documents),
c AS (
  SELECT source, lang, sum(quality) AS headings, sum(toxic + quality + 1) AS locators, sum(words) AS words
  FROM (SELECT w.source, w.lang, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, w.words FROM w LEFT JOIN labels l USING (doc_id)) GROUP BY 1, 2)
SELECT source, lang, CAST(headings AS BIGINT) AS headings, CAST(locators AS BIGINT) AS locators, CAST(words AS BIGINT) AS words,
       CAST(((2000 * headings::BIGINT * 1000000 + words::BIGINT) // (2 * words::BIGINT)) / 1000000.0 AS DECIMAL(24,6)) AS headings_per_1000,
       CAST(((2000 * locators::BIGINT * 1000000 + words::BIGINT) // (2 * words::BIGINT)) / 1000000.0 AS DECIMAL(24,6)) AS locators_per_1000
FROM c
""")
def density_rates(t: Tables) -> DataFrame:
    """Headings and locators per 1,000 words; labels stand in for both."""
    words = texts(t, "source", "lang").select("doc_id", "source", "lang", tx.count_tokens(F.col("text")).alias("words"))
    counts = words.join(t.labels, "doc_id", "left").select(
        "source", "lang", F.coalesce("quality", F.lit(0)).alias("headings"),
        (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) + 1).alias("locators"), "words",
    )
    return measure.density_rates(counts, ["source", "lang"])


def order_chunks(t: Tables) -> DataFrame:
    """Order keys as pages: 100 to a chunk, two context pages on each side."""
    spans = t.orders.groupBy(
        bucket_of(F.col("o_orderkey"), 5000).alias("source_id"), bucket_of(F.col("o_orderkey"), 100).alias("packet_order")
    ).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return spans.select(
        "source_id", F.concat(F.lit("CHUNK-"), F.col("packet_order")).alias("chunk_id"), "packet_order",
        F.array(F.array("lo", "hi")).alias("owned_ranges"),
        F.array(F.array(F.col("lo") - 2, F.col("lo") - 1), F.array(F.col("hi") + 1, F.col("hi") + 2)).alias("context_ranges"),
    )


ORDER_PAGES_SQL = """
WITH s AS (SELECT o_orderkey // 5000 AS source_id, o_orderkey // 100 AS packet_order, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1, 2),
cp AS (
  SELECT source_id, 'CHUNK-' || packet_order AS chunk_id, unnest(range(lo, hi + 1)) AS page, 'owned' AS ownership FROM s
  UNION ALL SELECT source_id, 'CHUNK-' || packet_order, unnest([lo - 2, lo - 1, hi + 1, hi + 2]), 'context' FROM s)
"""


@query(ORDER_PAGES_SQL + """
SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id, chunk_id ORDER BY page) AS chunk_page,
       page AS document_page, ownership FROM cp
""")
def sidecar(t: Tables) -> DataFrame:
    return pages.chunk_sidecar(order_chunks(t))


@query(ORDER_PAGES_SQL + """
SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id, chunk_id ORDER BY page) AS chunk_page, page, ownership FROM cp
""")
def numbered_chunk_pages(t: Tables) -> DataFrame:
    """The same numbers from pages that are expanded already."""
    expanded = pages.expand_chunks(order_chunks(t)).select("source_id", "chunk_id", "page", "ownership")
    return pages.number_chunk_pages(expanded)


@query(ORDER_PAGES_SQL + """
SELECT source_id, chunk_id, count(*) AS page_count, count(*) FILTER (ownership = 'owned') AS owned_page_count,
       count(*) FILTER (ownership = 'context') AS context_page_count FROM cp GROUP BY 1, 2
""")
def chunk_inventory(t: Tables) -> DataFrame:
    return pages.chunk_inventory(pages.expand_chunks(order_chunks(t)))


@query("""
WITH r AS (SELECT p_partkey // 37 AS c, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY 1 HAVING (p_partkey // 37) % 5 <> 3)
SELECT 'RANGE-' || c AS chunk_id, count(*) AS n_words FROM lineitem LEFT JOIN r ON l_partkey BETWEEN lo AND hi GROUP BY 1
""")
def range_owner(t: Tables) -> DataFrame:
    """Owning range of every line's part; every fifth range is left out."""
    spans = t.part.groupBy(bucket_of(F.col("p_partkey"), 37).alias("c")).agg(
        F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")
    ).filter("c % 5 <> 3")
    ranges = spans.select(
        F.lit("part").alias("source_id"), F.concat(F.lit("RANGE-"), F.col("c")).alias("chunk_id"),
        F.array(F.array("lo", "hi")).alias("owned_ranges"),
    )
    points = t.lineitem.groupBy(F.col("l_partkey").alias("page")).agg(F.count("*").alias("n"))
    owned = pages.owner_of(points.withColumn("source_id", F.lit("part")), ranges)
    return owned.groupBy("chunk_id").agg(F.sum("n").cast("bigint").alias("n_words"))


@query("""
SELECT source_id, page, CASE WHEN n_map = 0 THEN 'out_of_range' WHEN n_owned = 0 THEN 'gap' ELSE 'duplicate' END AS kind, n_owned
FROM (SELECT 'orders' AS source_id, page, count(*) FILTER (side = 'o') AS n_owned, count(*) FILTER (side = 'm') AS n_map
      FROM (SELECT l_orderkey AS page, 'o' AS side FROM lineitem UNION ALL SELECT o_orderkey, 'm' FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL)
WHERE n_map = 0 OR n_owned <> 1
""")
def page_coverage(t: Tables) -> DataFrame:
    """Orders as pages, lines as ownership claims."""
    claims = t.lineitem.select(
        F.lit("orders").alias("source_id"), F.col("l_orderkey").alias("page"), F.lit("owned").alias("ownership")
    )
    page_map = t.orders.select(
        F.lit("orders").alias("source_id"), F.col("o_orderkey").alias("page"),
        (F.col("o_orderstatus") != "P").alias("in_scope"),
    )
    return pages.coverage(claims, page_map)


@query("""
WITH s AS (SELECT source AS source_id, min(doc_id) // 20 AS lo, max(doc_id) // 20 AS hi FROM documents GROUP BY 1),
p AS (SELECT source_id, unnest(range(lo, hi + 1)) AS page, lo FROM s)
SELECT source_id, page, 'p. ' || (page - lo + 7) || CASE WHEN source_id = 'src0' THEN 'a' ELSE '' END AS label,
       page % 10 = 0 AS is_start, page % 25 = 0 AS is_special,
       CASE WHEN page % 25 = 0 THEN 'substantive_map_caption_only' ELSE 'body_and_substantive_notes' END AS role
FROM p
""")
def page_labels(t: Tables) -> DataFrame:
    """One map segment per source, with prefix and suffix, expanded and flagged."""
    page = bucket_of(F.col("doc_id"), 20)
    spans = t.documents.groupBy(F.col("source").alias("source_id")).agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    segments = spans.select(
        "source_id", F.lit("main").alias("mapping_id"), F.lit("sequence").alias("mode"),
        F.array("lo", "hi").alias("range"), F.lit("arabic").alias("label_style"), F.lit("7").alias("label_start"),
        F.lit("p. ").alias("prefix"), F.when(F.col("source_id") == "src0", "a").otherwise("").alias("suffix"),
        F.lit(True).alias("in_scope"), F.lit(True).alias("accepts_locators"),
    )
    expanded = pages.expand_page_map(segments)
    every = lambda n: expanded.filter(F.col("page") % n == 0).select("source_id", "page")
    starts = every(10).select("source_id", F.array(F.array("page", "page")).alias("owned_ranges"))
    flagged = pages.page_flags(expanded, starts, every(25))
    return flagged.select(
        "source_id", "page", "label", "is_start", "is_special", pages.page_role(F.col("is_special")).alias("role")
    )


@query("""
WITH r AS (SELECT d.source AS source_id, d.doc_id, coalesce(l.quality = 1, false) AS reused, coalesce(l.toxic = 1, false) AS new FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source_id, count(*) AS n_owned, count(*) FILTER (reused) AS n_reused, count(*) FILTER (new) AS n_new,
       count(*) FILTER (reused AND new) AS n_both, count(*) FILTER (NOT reused AND NOT new) AS n_unread, CAST(0 AS BIGINT) AS n_not_owned,
       count(*) FILTER (reused AND new) = 0 AND count(*) FILTER (NOT reused AND NOT new) = 0 AS complete
FROM r GROUP BY 1
""")
def inspection_progress(t: Tables) -> DataFrame:
    """Quality labels as reused pages, toxic labels as newly read pages."""
    owned = t.documents.select(F.col("source").alias("source_id"), F.col("doc_id").alias("page"))
    read = t.labels.select(F.col("doc_id").alias("page"), F.explode(F.array_compact(F.array(
        F.when(F.col("quality") == 1, "reused"), F.when(F.col("toxic") == 1, "new")
    ))).alias("kind"))
    return pages.inspection_progress(read.join(owned, "page"), owned)


@query("""
SELECT doc_id,
       CAST(1 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_changes,
       CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_other_changes, doc_id % 5 <> 0 AS metadata_only
FROM documents
""")
def metadata_only(t: Tables) -> DataFrame:
    """Measurements revised in their metadata; every fifth also in its count."""
    base = t.documents.select("doc_id", "source", "n_chars")

    def measurement(note: str, words: str, correction: bool) -> DataFrame:
        fields = [
            F.expr(f"named_struct('source_role_note', {note})").alias("protocol"),
            F.expr(words).alias("words"), "source",
        ]
        if correction:
            fields.append(F.expr("named_struct('reason', 'scope')").alias("metadata_correction"))
        return base.select("doc_id", F.to_json(F.struct(*fields)).alias("json"))

    old = measurement("'first'", "n_chars", False)
    new = measurement("if(doc_id % 4 = 0, 'second', 'first')", "if(doc_id % 5 = 0, n_chars + 1, n_chars)", True)
    leaves = [diff.flatten_json(d, ["doc_id"], "json") for d in (old, new)]
    return diff.metadata_only(
        *leaves, ["doc_id"], dropped=["/metadata_correction"], restored=["/protocol/source_role_note"]
    )

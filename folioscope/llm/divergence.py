"""How far the sources of a language differ in their words.

Texts are tokenized by one translate table: ``bytes.translate`` lowers the letters
and blanks every separator in one pass, ``bytes.split`` gives the terms and a
``Counter`` for each document their frequencies. A task adds the counters of its
documents up by (lang, source) and passes on one row per group and term.

Everything after that is sparse. A group's probability of a term it does not hold
depends on the group alone, so the distance of two sources is

    V * f(zero_a, zero_b)
    + sum over counts c of a of  m_a(c) * (f(p_a(c), zero_b) - f(zero_a, zero_b))
    + the same for b
    + sum over shared terms of   f(p_a, p_b) - f(p_a, zero_b) - f(zero_a, p_b) + f(zero_a, zero_b)

with m_a(c) the number of a's terms that occur c times. Only terms that both
sources hold meet in pairs, and those are counted by their two counts first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.shared import cut, table
from folioscope.llm.words import LETTER, LOWER, release, slices

MIN_DOCS = 10
TOP = 10
HELD = 100_000  # (group, term) entries a task holds before it passes them on
PART = 1 << 24  # bytes of a text that are split at once
SALTS = 32
_TABLE = bytes(LOWER[i] if LETTER[i] else 0x20 for i in range(256))


def document_terms(text: bytes) -> Counter:
    """Frequencies of the terms of one text, a part of it at a time."""
    if len(text) <= PART:
        return Counter(text.translate(_TABLE).split())
    out, first = Counter(), 0
    while first < len(text):
        part = text[first : first + PART].translate(_TABLE)
        if first + PART < len(text):
            end = part.rfind(b" ") + 1
            while not end:  # one term longer than a part
                size = 2 * len(part)
                part = text[first : first + size].translate(_TABLE)
                end = part.rfind(b" ") + 1 or (len(part) if first + size >= len(text) else 0)
            part = part[:end]
        out.update(part.split())
        first += len(part)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs); the empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def passed() -> pa.RecordBatch:
        groups = [(g, n, d) for g, (n, d) in held.items()]
        width = [len(n) for _, n, _ in groups]
        return pa.RecordBatch.from_arrays([
            pa.array([g[0] for (g, _, _), w in zip(groups, width) for _ in range(w)], pa.string()),
            pa.array([g[1] for (g, _, _), w in zip(groups, width) for _ in range(w)], pa.string()),
            pa.array([t for _, n, _ in groups for t in n], pa.binary()).cast(pa.string()),
            pa.array([c for _, n, _ in groups for c in n.values()], pa.int64()),
            pa.array([d[t] for _, n, d in groups for t in n], pa.int64()),
        ], ["lang", "source", "term", "n", "docs"])

    for batch in slices(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            terms = document_terms(text.as_py())
            if (lang, source) not in held:
                held[lang, source] = Counter({b"": 0}), Counter({b"": 0})
            n, docs = held[lang, source]
            size -= len(n)
            n.update(terms)
            docs.update(terms.keys())
            size += len(n)
        if size >= HELD:
            yield passed()
            held.clear()
            size = 0
    if held:
        yield passed()
    release()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) with a row of the empty term for each group."""
    text = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    rows = text.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)) in exact whole numbers."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20, 0)) * 1000000000BD) div cast({total} + 2 * {terms} as decimal(20, 0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _salted(big: DataFrame, on: Column) -> DataFrame:
    return big.withColumn("salt", F.pmod(F.xxhash64(on), F.lit(SALTS)))


def _copies(small: DataFrame, *columns: Column) -> DataFrame:
    """One copy a salt of a frame with a row per group, so that a hot group's rows spread."""
    return small.select(*columns, F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources, and their telling terms.

    Part ``pair``: each other source of the language with the distance over all
    kept terms. Part ``term``: the ``top`` terms a source uses more than its
    language does. Kept are terms in at least ``min_docs`` documents of the
    language. Null text, lang and source are read as empty; a text without terms
    still gives its group a row. Repeated rows count each time. Equal values
    rank by the item's UTF-8 bytes. A long text is split part by part. An empty
    table gives no rows; other columns are ignored. The sources of one term meet
    in one row, and pairs of sources are the result itself, so the number of
    sources of a language should stay in the thousands.
    """
    kept = term_counts(docs).groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("by"), F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")
    ).filter((F.col("term") == "") | (F.col("docs") >= min_docs))
    kept = cut(kept.select("lang", "term", "by", "lang_n"))
    terms = kept.filter("term <> ''")
    entries = terms.select("lang", "term", "lang_n", F.inline("by"))

    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = kept.filter("term = ''").select("lang", F.inline("by")).drop("n")
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total", "total")])
    groups = cut(groups.withColumn("zero", F.when(F.col("terms") > 0, probability("0", "total", "terms"))))

    def side(tag: str) -> DataFrame:
        return _copies(groups, "lang", F.col("source").alias(tag), F.col("terms"),
                       F.col("total").alias(f"total_{tag}"), F.col("zero").alias(f"zero_{tag}"))

    # Terms of a source above its language.
    full = _copies(groups, F.col("lang"), F.col("source"), F.col("terms"), F.col("total"), F.col("lang_total"))
    telling = _salted(entries.filter("n > 0"), F.col("term")).join(full, ["lang", "source", "salt"]).withColumns({
        "p": probability("n", "total", "terms"), "q": probability("lang_n", "lang_total", "terms")}).filter("p > q")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    telling = telling.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                             distance("p", "q").alias("value")).withColumn("rank", F.row_number().over(order))
    telling = telling.filter(F.col("rank") <= top)

    # Distances: what both lack, what one holds by its count, what both hold by their counts.
    one, two = groups.select("lang", F.col("source").alias("a"), "terms", F.col("zero").alias("zero_a")), groups.select(
        "lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    lacking = one.join(two, "lang").filter("a < b").select(
        "lang", "a", "b", F.coalesce(F.col("terms") * distance("zero_a", "zero_b"), F.lit(0)).alias("value"))
    spectrum = entries.filter("n > 0").groupBy("lang", F.col("source").alias("a"), "n").agg(F.count("*").alias("m"))
    others = _copies(groups, F.col("lang"), F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    single = (
        _salted(spectrum, F.col("n")).join(side("a"), ["lang", "a", "salt"])
        .join(others, ["lang", "salt"]).filter("a <> b")
        .withColumn("p", probability("n", "total_a", "terms"))
        .select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                (F.col("m") * (distance("p", "zero_b") - distance("zero_a", "zero_b"))).alias("value"))
    )
    both = (
        terms.select("lang", "by", F.explode("by").alias("x")).select("lang", "x", F.explode("by").alias("y"))
        .filter("x.n > 0 and y.n > 0 and x.source < y.source")
        .groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"),
                 F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).agg(F.count("*").alias("m"))
    )
    shared = (
        _salted(both, F.struct("n_a", "n_b")).join(side("a"), ["lang", "a", "salt"])
        .join(side("b").drop("terms"), ["lang", "b", "salt"])
        .withColumns({"p": probability("n_a", "total_a", "terms"), "q": probability("n_b", "total_b", "terms")})
        .select("lang", "a", "b", (F.col("m") * (
            distance("p", "q") - distance("p", "zero_b") - distance("zero_a", "q") + distance("zero_a", "zero_b"))
        ).alias("value"))
    )
    pairs = lacking.unionByName(single).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(telling)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, l.v, l.total AS lang_total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS p,
         1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS q
  FROM f),
s AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM o WHERE part = 'pair' OR rank <= 10
"""

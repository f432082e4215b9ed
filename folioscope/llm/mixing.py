"""Mix sources to target weights: hash-random keys, prefix sums, an exact cut per source.

Every document gets a key that depends only on its id. Inside a source the
documents are in key order, and the order is cut into ranges of the key: its
first two hex digits, then the next two. A key is uniform, so ranges of equal
width hold about equal shares and need no sampling. The prefix sum of a document
is the sum of the earlier first-level ranges (at most 256 of a source), plus the
earlier second-level ranges (at most 256 of a first-level range), plus the
earlier documents of its own second-level range. A source with a third of all
rows is thus spread over 65,536 groups, and no join has a source as its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.shared import WORD, before, cut, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def n_words(text: Column) -> Column:
    """Number of words; a run of blanks after a word belongs to it."""
    return F.length(F.regexp_replace(
        F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", ""), WORD + r"[\x20\x09-\x0D]*", "w"
    )).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with weight and target words per source.

    ``sizes`` has one row per source. Sources by code point, null last, take the
    weights in turn. A target stops at ``epochs`` times the size; the excess is
    shared again by weight. In the order of size per weight the capped sources
    come first, so the level all others share is found from one prefix sum.
    """
    name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    ranked = ranked.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn(
        "ratio", F.col("cap") / F.col("weight")
    )
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (
        F.lit(share) * F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    ) / F.sum("weight").over(later)
    leveled = ranked.withColumn("level", level)
    shared = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return leveled.select(
        "source", "source_size",
        F.least("cap", F.coalesce(F.col("weight") * shared, F.col("cap"))).alias("target"),
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, row: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, key, source_size, target, taken.

    ``taken`` counts the words of the document in the mix: whole epochs of its
    source, and in the last epoch the words before the source's exact cut, which
    may fall inside one document. Null or empty texts have size 0 and take 0.
    Null ids share one key; equal keys are ordered by id and size, so repeated
    rows are interchangeable. Null is a source of its own. An empty table gives
    no rows. A long text counts by its words like any other. Other columns are
    ignored, but for ``row``: a column that names each row, which is carried along
    and orders rows that are otherwise equal.
    """
    own = [row] if row else []
    keyed = docs.select(
        "doc_id", "source", *own, n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    keyed = cut(keyed.withColumns({
        "k1": F.substring("key", 1, 2), "k2": F.substring("key", 3, 2),
        # joins by equality need null and the empty source apart
        "sk": F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))),
    }))
    fine = keyed.groupBy("source", "sk", "k1", "k2").agg(F.sum("size").alias("n"))
    fine = cut(fine)
    coarse = fine.groupBy("source", "sk", "k1").agg(F.sum("n").alias("n"))
    targets = source_targets(
        coarse.groupBy("source", "sk").agg(F.sum("n").alias("source_size")).drop("sk"), weights, share, epochs
    ).select(
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("sk"),
        "source_size", "target",
    )
    coarse = coarse.select("sk", "k1", before("n", ["sk"], ["k1"]).alias("base")).join(targets, "sk")
    fine = fine.select("sk", "k1", "k2", before("n", ["sk", "k1"], ["k2"]).alias("inner")).join(coarse, ["sk", "k1"])
    start = before("size", ["sk", "k1", "k2"], ["key", "doc_id", "size", *own]) + F.col("inner") + F.col("base")
    budget = F.floor(F.col("target")).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - whole * F.col("source_size")
    return (
        keyed.join(fine, ["sk", "k1", "k2"]).withColumn("start", start)
        .withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("bigint"))
        .select("doc_id", "source", *own, "size", "key", "source_size", "target", whole.alias("epochs"), "last",
                (whole * F.col("size") + F.col("last")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix as documents: each epoch is a row, the document at the cut ends there.

    Columns of ``docs`` in their order; ``n_chars``, where present, counts the
    text that stays. Documents of which no word is taken go. Rows are named and
    stored first, so each meets its own share, whatever ids and texts repeat.
    """
    named = stored(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mixing")
    plan = mix(named, weights, share, epochs, row="_mix_row").filter("taken > 0").select(
        "_mix_row", F.col("size").alias("_mix_size"), F.col("epochs").alias("_mix_epochs"), F.col("last").alias("_mix_last"))
    met = named.join(plan, "_mix_row")
    whole = F.array_repeat(F.col("_mix_size"), F.col("_mix_epochs").cast("int"))
    part = F.when(F.col("_mix_last") > 0, F.array(F.col("_mix_last"))).otherwise(F.array().cast("array<bigint>"))
    rows = met.withColumn("_mix_take", F.explode(F.concat(whole, part))).filter("_mix_take > 0")
    # Each piece ends with a word, so the first n pieces hold n words.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, 1, F.col("_mix_take").cast("int")), "")
    cut_text = F.when(F.col("_mix_take") < F.col("_mix_size"), head).otherwise(F.col("text"))
    rows = rows.withColumn("text", cut_text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.length("text").cast(kind))
    return rows.select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT min_by(level, ratio) FROM l WHERE ratio > level), cap)) AS target
  FROM l),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size
                 + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken
FROM p
"""

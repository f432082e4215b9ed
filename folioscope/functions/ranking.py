"""Positions inside a group without sorting the whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.numbers import bucket_of


def _sums_before(sizes: DataFrame, group: list[str], level: int, width: int) -> DataFrame:
    """(group, _b, _offset): the sum of ``_n`` over the smaller ``_b`` of the group."""
    inside = F.coalesce(F.sum("_n").over(
        W.partitionBy(*group, *(["_c"] if level else [])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ), F.lit(0))
    if level == 0:
        return sizes.select(*group, "_b", inside.alias("_offset"))
    coarse = sizes.withColumn("_c", bucket_of(F.col("_b"), width))
    totals = coarse.groupBy(*group, "_c").agg(F.sum("_n").alias("_n"))
    outer = _sums_before(totals.withColumnRenamed("_c", "_b"), group, level - 1, width)
    outer = outer.select(*group, F.col("_b").alias("_c"), F.col("_offset").alias("_base"))
    return coarse.withColumn("_in", inside).join(outer, [*group, "_c"]).select(
        *group, "_b", (F.col("_in") + F.col("_base")).alias("_offset")
    )


def bucketed_position(
    df: DataFrame, group: list[str], order: str, name: str, width: int = 65536, levels: int = 4
) -> DataFrame:
    """1-based rank of the unique whole-number column ``order`` inside each group.

    Rows are ranked inside (group, order div width), which holds at most
    ``width`` rows, and shifted by the number of rows in the earlier buckets. A
    group with a third of all rows is spread over its buckets. The bucket sums
    are bucketed again, ``levels`` times in all: 4 bounds every sort by ``width``
    rows for any 64-bit order; 2 do for a 32-bit order.
    """
    bucketed = df.withColumn("_b", bucket_of(F.col(order), width))
    sizes = bucketed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    offsets = _sums_before(sizes, group, levels - 1, width)
    local = W.partitionBy(*group, "_b").orderBy(order)
    return (
        bucketed.join(offsets, [*group, "_b"])
        .withColumn(name, (F.row_number().over(local) + F.col("_offset")).cast("bigint"))
        .drop("_b", "_offset")
    )


# A range lies in at most this many bins of its level, plus one.
FAN = 16


def _level(lo: Column, hi: Column, width: int) -> Column:
    """Smallest level at which bins of ``width * FAN**level`` cover the range in FAN + 1 bins."""
    size = hi.cast("decimal(20,0)") - lo.cast("decimal(20,0)")
    level = F.lit(0)
    for k in range(1, 17):
        level = F.when(size >= F.lit(str(width * FAN**k)).cast("decimal(38,0)"), k).otherwise(level)
    return level


def range_join(
    points: DataFrame, ranges: DataFrame, by: list[str], point: str, lo: str, hi: str,
    width: int = 1024, how: str = "inner",
) -> DataFrame:
    """Join points to the closed ranges holding them by equality on (by, bin).

    A range of any length is copied to at most ``FAN + 1`` bins: longer ranges
    use wider bins. Points meet each width that occurs, of which there are at
    most 17. The join is a hash or merge join, never a nested loop. Reversed
    ranges hold nothing; ``how`` is ``inner`` or ``left``.
    """
    leveled = ranges.filter(F.col(lo) <= F.col(hi)).withColumn("_level", _level(F.col(lo), F.col(hi), width))
    # At most 17 numbers.
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect()) or [0]
    found, rest = None, points
    for k in levels:
        size = width * FAN**k
        last = k == levels[-1] and how == "left"
        r = leveled.filter(F.col("_level") == k).withColumn(
            "_rbin", F.explode(F.sequence(bucket_of(F.col(lo), size), bucket_of(F.col(hi), size)))
        ).select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in ranges.columns if c not in by], "_rbin")

        def meets(p: DataFrame, r: DataFrame = r, size: int = size) -> Column:
            cond = (bucket_of(p[point], size) == r["_rbin"]) & p[point].between(r[lo], r[hi])
            for c in by:
                cond = cond & (p[c] == r[f"_r_{c}"])
            return cond

        single = last and len(levels) == 1
        met = points.join(r, meets(points), "left" if single else "inner")
        met = met.drop("_rbin", *[f"_r_{c}" for c in by])
        found = met if found is None else found.unionByName(met)
        if how == "left" and not single:
            rest = rest.join(r, meets(rest), "left_anti")
    if how == "left" and len(levels) > 1:
        found = found.unionByName(rest, allowMissingColumns=True)
    return found


def explode_range(
    df: DataFrame, keys: list[str], lo: Column, hi: Column, name: str, block: int = 65536
) -> DataFrame:
    """One row per whole number of the closed range lo..hi; none when hi < lo.

    Ranges are cut into blocks, and blocks are dealt out by (keys, block), so a
    range with a very large share of all numbers is written by many tasks.
    """
    first, last = lo.cast("bigint"), hi.cast("bigint")
    ranges = df.withColumns({"_lo": first, "_hi": last}).filter("_lo <= _hi")
    blocks = ranges.withColumn(
        "_from", F.explode(F.sequence("_lo", "_hi", F.lit(block).cast("bigint")))
    ).repartition(*keys, "_from")
    upto = F.least(F.col("_hi"), F.col("_from") + (block - 1))
    return blocks.withColumn(name, F.explode(F.sequence("_from", upto))).drop("_lo", "_hi", "_from")

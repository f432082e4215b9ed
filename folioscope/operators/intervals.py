"""Coverage and progress over ranges, by a sweep over their ends.

A range costs two rows however long it is; no page is expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scan import scan
from folioscope.functions.sides import stack


def segments(ranges: DataFrame, whole: DataFrame, scope: list[str], lo: str, hi: str) -> DataFrame:
    """(*scope, first, last, depth, expected): maximal ranges of equal cover.

    ``ranges(*scope, lo, hi)`` are assignments, ``whole(*scope, lo, hi)`` what is to
    be covered; ends are inclusive. ``depth`` and ``expected`` count the ranges of
    either kind that hold the pages first..last. A range with a NULL end or
    ``hi`` below ``lo`` covers nothing.
    """
    def ends(df: DataFrame, kind: str) -> DataFrame:
        real = df.filter(F.col(lo).isNotNull() & (F.col(lo) <= F.col(hi)))
        at = F.explode(F.array(F.struct(F.col(lo).cast("bigint").alias("p"), F.lit(1).alias("d")),
                               F.struct((F.col(hi).cast("bigint") + 1).alias("p"), F.lit(-1).alias("d"))))
        rows = real.select(*scope, at.alias("_e"))
        zero = F.lit(0)
        return rows.select(*scope, F.col("_e.p").alias("first"), (F.col("_e.d") if kind == "range" else zero).alias("_a"),
                           (F.col("_e.d") if kind == "whole" else zero).alias("_w"))

    steps = stack([ends(ranges, "range"), ends(whole, "whole")]).groupBy(*scope, "first").agg(
        F.sum("_a").alias("_a"), F.sum("_w").alias("_w")).filter("_a <> 0 or _w <> 0")
    swept = scan(steps, scope, ["first"], sums={"_da": "_a", "_dw": "_w"}, following={"_next": "first"})
    return swept.select(
        *scope, "first", (F.col("_next") - 1).alias("last"), (F.col("_da") + F.col("_a")).cast("bigint").alias("depth"),
        (F.col("_dw") + F.col("_w")).cast("bigint").alias("expected"),
    ).filter("last is not null and (depth > 0 or expected > 0)")


def interval_coverage(ranges: DataFrame, whole: DataFrame, scope: list[str], lo: str, hi: str) -> DataFrame:
    """(*scope, first, last, depth, problem): ranges not covered exactly once.

    ``gap``: expected and not assigned; ``overlap``: assigned more than once;
    ``outside``: assigned and not expected.
    """
    problem = (
        F.when(F.col("expected") == 0, "outside").when(F.col("depth") == 0, "gap").when(F.col("depth") > 1, "overlap")
    )
    found = segments(ranges, whole, scope, lo, hi).withColumn("problem", problem)
    return found.filter("problem is not null").select(*scope, "first", "last", "depth", "problem")


def interval_progress(inspected: DataFrame, whole: DataFrame, scope: list[str], lo: str, hi: str) -> DataFrame:
    """(*scope, n_pages, n_inspected, n_open, next_page, complete) of the ranges to inspect.

    Pages inspected twice count once, pages outside ``whole`` do not count.
    ``next_page`` is the first open page.
    """
    size = F.col("last") - F.col("first") + 1
    is_open = F.col("depth") == 0
    due = segments(inspected, whole, scope, lo, hi).filter("expected > 0")
    return due.groupBy(*scope).agg(
        F.sum(size).alias("n_pages"), F.sum(F.when(is_open, 0).otherwise(size)).alias("n_inspected"),
        F.sum(F.when(is_open, size).otherwise(0)).alias("n_open"), F.min(F.when(is_open, F.col("first"))).alias("next_page"),
    ).withColumn("complete", F.col("n_open") == 0)

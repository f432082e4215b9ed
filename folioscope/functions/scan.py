"""Running sums and maxima along an order, inside scopes of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def scan(
    df: DataFrame, scope: list[str], order: list[str],
    sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, following: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with sums and maxima over the earlier rows of the scope, and values of the next row.

    Each argument maps a new column to the column it reads. Rows are split into
    ranges of (scope, order); a row's result is that of its own range plus one
    carried number from the ranges before, so a scope with a third of all rows
    is spread over many tasks. The carry has one row a scope and range. Rows of
    equal order should be one row. Sums start at 0, maxima at NULL, and NULL
    scopes are a scope.
    """
    sums, maxima, following = sums or {}, maxima or {}, following or {}
    placed = cut_lineage(df.repartitionByRange(*scope, *order).withColumn("_part", F.spark_partition_id()))
    own = W.partitionBy("_part", *scope).orderBy(*order)
    earlier = own.rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumns(
        {f"_own_{new}": F.sum(old).over(earlier) for new, old in sums.items()}
        | {f"_own_{new}": F.max(old).over(earlier) for new, old in maxima.items()}
        | {f"_own_{new}": F.lead(F.struct(old)).over(own) for new, old in following.items()}
    )
    first = F.struct(*order)
    parts = placed.groupBy("_part", *scope).agg(
        F.count("*").alias("_n"),
        *[F.sum(old).alias(f"_in_{new}") for new, old in sums.items()],
        *[F.max(old).alias(f"_in_{new}") for new, old in maxima.items()],
        *[F.min_by(F.struct(old), first).alias(f"_in_{new}") for new, old in following.items()],
    )
    by_part = W.partitionBy(*scope).orderBy("_part")
    before = by_part.rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(
        F.col("_part").alias("_at"), *[F.col(c).alias(f"_at_{i}") for i, c in enumerate(scope)],
        *[F.sum(f"_in_{new}").over(before).alias(f"_far_{new}") for new in sums],
        *[F.max(f"_in_{new}").over(before).alias(f"_far_{new}") for new in maxima],
        *[F.lead(f"_in_{new}").over(by_part).alias(f"_far_{new}") for new in following],
    )
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{i}"))
    met = local.join(carried, same)
    return met.select(
        *df.columns,
        *[(F.coalesce(f"_own_{new}", F.lit(0)) + F.coalesce(f"_far_{new}", F.lit(0))).alias(new) for new in sums],
        *[F.greatest(f"_own_{new}", f"_far_{new}").alias(new) for new in maxima],
        *[F.coalesce(f"_own_{new}", f"_far_{new}")[old].alias(new) for new, old in following.items()],
    )

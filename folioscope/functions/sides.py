"""Compare two frames by key with one aggregation.

A full outer join cannot be split on a hot key; a tagged union followed by a
hash aggregate can, because every task combines its own rows first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(df: DataFrame, side: str, keys: list[str], values: list[str] | None = None) -> DataFrame:
    return df.select(*keys, *(values or []), F.lit(side).alias("_side"))


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def side_count(side: str) -> Column:
    return F.count_if(F.col("_side") == side)


def side_value(side: str, value: str) -> Column:
    """The value a side holds; for a key it holds twice, the largest one."""
    return F.max(F.when(F.col("_side") == side, F.col(value)))


def key_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: how often each side holds it."""
    return (
        stack([tag(left, "left", keys), tag(right, "right", keys)])
        .groupBy(*keys)
        .agg(side_count("left").alias("n_left"), side_count("right").alias("n_right"))
    )

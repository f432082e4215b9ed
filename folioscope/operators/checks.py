"""Check rows ``(check, scope, ok, detail)`` and their verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.sides import stack
from folioscope.functions.skew import grown
from folioscope.session import cut_lineage


def check_rows(df: DataFrame, check: str | Column, scope: Column, ok: Column, detail: Column) -> DataFrame:
    """One check row per input row; an unknown outcome counts as a failure."""
    return df.select(
        (F.lit(check) if isinstance(check, str) else check).alias("check"),
        scope.cast("string").alias("scope"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        detail.cast("string").alias("detail"),
    )


def all_checks(frames: list[DataFrame]) -> DataFrame:
    return stack(frames)


def none_of(releases: DataFrame, problems: dict[str, DataFrame]) -> DataFrame:
    """One check row per release and check: it has none of the check's problems.

    ``releases(release_id, scope)``; ``problems`` gives ``(release_id, detail)`` by
    check. All checks share one aggregation and one join, so the plan does not grow
    by a join a check; the counted problems are checkpointed for the same reason.
    """
    listed = stack([p.select("release_id", F.lit(check).alias("check"), "detail") for check, p in problems.items()])
    counted = cut_lineage(listed.groupBy("release_id", "check").agg(F.count("*").alias("n"), F.min("detail").alias("first")))
    names = F.explode(F.array(*[F.lit(check) for check in problems])).alias("check")
    joined = releases.select("release_id", "scope", names).join(grown(counted), ["release_id", "check"], "left")
    return check_rows(joined, F.col("check"), F.col("scope"), F.col("n").isNull(), F.col("first"))


def verdict(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Passed only if every check row passed."""
    return checks.groupBy(*(by or [])).agg(
        F.count("*").alias("n_checks"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.bool_and("ok").alias("ok"),
    )

"""Sinks: measurement reports, check reports and stage snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_measurement(
    pages: DataFrame, chunks: DataFrame, joins: DataFrame, path: str, fmt: str = "parquet"
) -> None:
    """Totals, chunks, pages and joins as four tables under one folder.

    One row per page stays one row; a source with many pages is never gathered
    into a single nested document.
    """
    totals = chunks.groupBy("source_id").agg(
        F.sum("words").alias("words"), F.count("*").alias("chunks")
    )
    tables = {"totals": totals, "chunks": chunks, "pages": pages, "joins": joins}
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def write_checks(checks: DataFrame, path: str) -> None:
    """Append check rows ``(check, scope, ok, detail)``."""
    checks.select("check", "scope", "ok", "detail").write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, stage: int) -> None:
    """Replace one stage of a staged dataset and leave the other stages alone."""
    df.write.mode("overwrite").parquet(f"{path}/stage={stage}")


def read_snapshot(df_spark, path: str, stage: int) -> DataFrame:
    """The rows written for one stage."""
    return df_spark.read.parquet(f"{path}/stage={stage}")

"""Stages of a dataset that become visible only after their checks pass.

A dataset is a folder: ``data/<run>`` and ``checks/<run>`` hold what a run wrote,
``log`` has one row a run. Data is written first, then its checks, then one row
of the log; readers see a run through the log only. A writer that dies, or
whose checks fail, leaves files nobody reads, and the stage before stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.checks import verdict

LOG = "stage int, seq bigint, run string, ok boolean, n_checks bigint, n_failed bigint"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per run, in the order of ``seq`` within a stage."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except Exception as e:  # before the first run there is no log
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LOG)
        raise


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The run that is visible for each stage: the last one whose checks passed."""
    return read_log(spark, path).filter("ok").groupBy("stage").agg(F.max_by("run", F.struct("seq", "run")).alias("run"))


def read_stage(spark: SparkSession, path: str, stage: int) -> DataFrame:
    """The rows of the stage's visible run."""
    run = committed(spark, path).filter(F.col("stage") == stage).first()
    if run is None:
        raise ValueError(f"stage {stage} of {path} has no run that passed its checks")
    return spark.read.parquet(f"{path}/data/{run.run}")


def publish(df: DataFrame, path: str, stage: int, checks: Callable[[DataFrame], DataFrame]) -> bool:
    """Write a stage, judge what was written, and make it visible if it passed.

    ``checks`` turns the written rows into check rows ``(check, scope, ok,
    detail)``; no check row at all is no pass. Stages before must be visible.
    Returns whether the run passed. Two writers of one stage do no harm: the
    later ``seq`` (then run) is seen.
    """
    spark = df.sparkSession
    log = read_log(spark, path)
    if stage > 0 and log.filter(F.col("ok") & (F.col("stage") == stage - 1)).isEmpty():
        raise ValueError(f"stage {stage - 1} of {path} is not published")
    run = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{run}")
    written = spark.read.schema(df.schema).parquet(f"{path}/data/{run}")
    checks(written).select("check", "scope", "ok", "detail").write.parquet(f"{path}/checks/{run}")
    judged = verdict(spark.read.parquet(f"{path}/checks/{run}")).first()
    ok = judged.n_checks > 0 and bool(judged.ok)
    last = log.filter(F.col("stage") == stage).agg(F.max("seq")).first()[0]
    row = spark.createDataFrame([(stage, (last or 0) + 1, run, ok, judged.n_checks, judged.n_failed)], LOG)
    # One file, renamed into place by the committer: a reader sees the row or doesn't.
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return ok


def stage_checks(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The check rows of a run, passed or not."""
    return spark.read.parquet(f"{path}/checks/{run}")

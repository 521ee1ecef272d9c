"""The run log: what ran, how it ended, and what a reader is told."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A run that is still running after so long is stale; an open latch blocks for so long.
STALE = timedelta(hours=6)
LATCH = timedelta(hours=48)


def latest(log: DataFrame, kinds: list[str], now: datetime) -> DataFrame:
    """(insight_type, status, last_completed) of every kind: never_run without a row; running turns stale after six hours; else the
    status of the latest row. last_completed is the start of the latest run that completed. The log is cut to a row for each kind by
    an aggregate, so its history isn't sorted."""
    last = log.groupBy("insight_type").agg(
        F.max_by("status", F.struct("started_at", "id")).alias("state"), F.max("started_at").alias("at"), F.max(F.when(F.col("status") == "completed", F.col("started_at"))).alias("last_completed")
    )
    old = F.lit((now - STALE).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    told = F.when(F.col("state").isNull(), "never_run").when((F.col("state") == "running") & (F.col("at") < old), "stale").otherwise(F.col("state"))
    every = log.sparkSession.createDataFrame([(k,) for k in kinds], "insight_type string")
    return every.join(last, "insight_type", "left").select("insight_type", told.alias("status"), "last_completed")


def latches(rows: DataFrame, now: datetime) -> DataFrame:
    """(loader, version, blocks) of loader latches: one that lacks a signal blocks until it is 48 hours old, by its last refresh."""
    at = F.coalesce("refreshed_at", "created_at")
    edge = F.lit((now - LATCH).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return rows.select("loader", "version", (F.col("open") & (at >= edge)).alias("blocks"))


def interrupted(log: DataFrame) -> DataFrame:
    """The log after a restart: runs that were running are interrupted."""
    return log.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def history(log: DataFrame, kind: str, n: int) -> DataFrame:
    order = Window.orderBy(F.desc("started_at"), F.desc("id"))
    return log.where(F.col("insight_type") == kind).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)

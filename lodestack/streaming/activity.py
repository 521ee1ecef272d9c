"""Activity as a stream: daily counts that follow events as they come. Each read checks both what was agreed to when an event happened
and what is granted now. The batch summary stays authoritative: a consent that is revoked later takes rows back from days that
no new event reaches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.consent import checked_purposes
from lodestack.sources.snapshots import SnapshotStore


def daily(events: DataFrame, purposes: list[str], eligible: DataFrame, late: str = "7 days") -> DataFrame:
    """(summary_date, dimension_key, record_count, subject_count) of a stream of events whose subjects are in eligible(subject_id) as
    it was when the stream began; days close once the watermark passes them, so state holds `late` of them. Subjects are counted
    approximately: an exact count would keep every subject of a day. publish_daily is exact and asks for grants again."""
    agreed = events.where(_agreed(purposes)).join(eligible.select("subject_id"), "subject_id", "left_semi")
    kept = agreed.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    counts = kept.groupBy(F.window("at", "1 day").alias("day"), F.col("event_type").alias("dimension_key"))
    counts = counts.agg(F.count("*").alias("record_count"), F.approx_count_distinct("subject_id").alias("subject_count"))
    return counts.select(F.to_date("day.start").alias("summary_date"), "dimension_key", "record_count", "subject_count")


def _agreed(purposes: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.array_contains("consent_purposes", p) for p in checked_purposes(purposes)])


def distinct_events(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events without repeated deliveries, by event_id within the watermark."""
    return events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def publish_daily(events: DataFrame, purposes: list[str], eligible: Callable[[], DataFrame], store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """Keeps table activity_daily in step with a stream of events(event_id, event_type, subject_id, occurred_at, consent_purposes).

    A batch is written under its number, so one that is delivered again replaces itself; then the days it reaches are counted
    anew from all their events, each event once, with the grants that eligible() gives at that time."""
    log = f"{store.folder.root}/activity_log"

    def merge(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("occurred_at")).write.mode("overwrite").partitionBy("day").parquet(f"{log}/batch={number}")
        spark = batch.sparkSession
        kept = spark.read.schema(batch.schema.add("day", "date").add("batch", "long")).option("basePath", log).parquet(log)
        days = [r[0] for r in kept.where(F.col("batch") == number).select("day").distinct().collect()]  # days, not events
        if not days:
            return
        rows = kept.where(F.col("day").isin(days) & _agreed(purposes)).dropDuplicates(["event_id"]).join(eligible().select("subject_id"), "subject_id", "left_semi")
        counts = rows.groupBy(F.col("day").alias("summary_date"), F.col("event_type").alias("dimension_key"))
        counts = counts.agg(F.count("*").alias("record_count"), F.countDistinct("subject_id").alias("subject_count"))
        store.replace_where("activity_daily", counts, "summary_date IN (" + ", ".join(f"DATE '{d}'" for d in days) + ")")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

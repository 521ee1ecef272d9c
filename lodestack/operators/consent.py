"""Consented reads of activity: what was agreed to when an event happened, and what is granted now, must both allow it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Purposes that a read may name; fixed values.
PURPOSES = ("analytics", "personalization", "training")


class ConsentPurposeError(ValueError):
    """No purpose, or one that isn't known."""


class WindowError(ValueError):
    """A window that is empty or whose ends carry no time zone."""


def checked_purposes(purposes: list[str] | tuple[str, ...]) -> list[str]:
    found = list(dict.fromkeys(purposes))
    if not found or not set(found) <= set(PURPOSES):
        raise ConsentPurposeError(f"purposes must be some of {PURPOSES}: {found}")
    return found


def checked_window(since: datetime, until: datetime) -> tuple[str, str]:
    """The half-open window as UTC literals."""
    if since.tzinfo is None or until.tzinfo is None:
        raise WindowError("window ends need a time zone")
    if since >= until:
        raise WindowError("the window is empty")
    from datetime import timezone

    return tuple(t.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f") for t in (since, until))


def eligible_subjects(user_subjects: DataFrame, grants: DataFrame, purposes: list[str], now: datetime, subjects: DataFrame | None = None) -> DataFrame:
    """Subjects with a grant in force for every purpose; subjects(subject_id) can narrow them, never widen. Users stay inside."""
    wanted = checked_purposes(purposes)
    live = grants.where(F.col("purpose").isin(wanted) & F.col("revoked_at").isNull() & (F.col("granted_at") <= F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")))
    pairs = user_subjects.join(live.select("user_id", "purpose").distinct(), "user_id").select("subject_id", "purpose").distinct()
    out = pairs.groupBy("subject_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("subject_id")
    return out.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi") if subjects is not None else out


def consented(rows: DataFrame, eligible: DataFrame, purposes: list[str], since: datetime, until: datetime, kinds: tuple[str, list[str]] | None = None) -> DataFrame:
    """Rows in the window whose own consent has every purpose and whose subject is eligible; kinds: a column and its values.
    The window is a plain range on occurred_at, so partitions and row groups outside of it aren't read."""
    low, high = checked_window(since, until)
    at = F.col("occurred_at")
    kept = rows.where((at >= F.lit(low).cast("timestamp_ntz")) & (at < F.lit(high).cast("timestamp_ntz")))
    for p in checked_purposes(purposes):
        kept = kept.where(F.array_contains("consent_purposes", p))
    if kinds:
        kept = kept.where(F.col(kinds[0]).isin(kinds[1]))
    return kept.join(eligible, "subject_id", "left_semi")


def keyset_page(rows: DataFrame, key: str, after: tuple | None, size: int) -> DataFrame:
    """The next `size` rows by (occurred_at, key) behind a cursor; a top-k of the range, not a full sort."""
    if size < 1:
        raise ValueError("a page has at least one row")
    if after is not None:
        at, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.where((F.col("occurred_at") > at) | ((F.col("occurred_at") == at) & (F.col(key) > last)))
    return rows.orderBy("occurred_at", key).limit(size)


def activity_summary(events: DataFrame, impressions: DataFrame) -> DataFrame:
    """(summary_date, dimension, dimension_key, record_count, subject_count, candidate_set_count) by UTC day: events by type,
    impressions by policy; candidate sets are null, not 0, for events."""
    day = F.to_date("occurred_at").alias("summary_date")
    # Distinct subjects through a first aggregate on them, so a hot type is spread by subject.
    e = events.groupBy(day, F.col("event_type").alias("dimension_key"), "subject_id").agg(F.count("*").alias("n"))
    e = e.groupBy("summary_date", "dimension_key").agg(F.sum("n").alias("record_count"), F.count("subject_id").alias("subject_count"))
    e = e.select("summary_date", F.lit("event_type").alias("dimension"), "dimension_key", "record_count", "subject_count", F.lit(None).cast("long").alias("candidate_set_count"))
    p = impressions.groupBy(day, F.col("policy_id").alias("dimension_key")).agg(
        F.count("*").alias("record_count"), F.countDistinct("subject_id").alias("subject_count"), F.countDistinct("candidate_set_id").alias("candidate_set_count")
    )
    return e.unionByName(p.withColumn("dimension", F.lit("policy_id")))

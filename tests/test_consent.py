from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestack.operators import consent

NOW = datetime(2024, 1, 31)
SINCE, UNTIL = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 3, tzinfo=timezone.utc)


def tables(spark, events, grants):
    e = spark.createDataFrame([(i, s, "view", t, p) for i, (s, t, p) in enumerate(events)], "event_id long, subject_id long, event_type string, occurred_at string, consent_purposes array<string>")
    e = e.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    g = spark.createDataFrame([(u, p, a, r) for u, p, a, r in grants], "user_id long, purpose string, granted_at string, revoked_at string")
    g = g.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("granted_at", "revoked_at")})
    u = spark.createDataFrame([(i, 100 + i) for i in range(10)], "user_id long, subject_id long")
    return e, g, u


def read(spark, events, grants, purposes, subjects=None):
    e, g, u = tables(spark, events, grants)
    who = consent.eligible_subjects(u, g, purposes, NOW, subjects)
    out = consent.consented(e, who, purposes, SINCE, UNTIL)
    assert "user_id" not in out.columns
    return {r["event_id"] for r in out.collect()}


def test_event_and_grant_must_both_allow(spark):
    events = [(101, "2024-01-01", ["analytics"]), (101, "2024-01-01", []), (102, "2024-01-01", ["analytics"]), (102, "2024-01-01", [])]
    assert read(spark, events, [(1, "analytics", "2023-01-01", None)], ["analytics"]) == {0}


def test_revoked_late_and_other_grants_do_not_count(spark):
    events = [(100 + i, "2024-01-02", ["analytics", "training"]) for i in range(1, 6)]
    grants = [(1, "analytics", "2023-01-01", "2023-02-01"), (2, "analytics", "2025-01-01", None), (3, "training", "2023-01-01", None), (4, "analytics", "2023-01-01", None)]
    assert read(spark, events, grants, ["analytics"]) == {3}
    both = [*grants, (4, "training", "2023-01-01", None), (4, "training", "2023-03-01", None)]
    assert read(spark, events, both, ["analytics", "training", "training"]) == {3}
    assert read(spark, events, grants, ["analytics", "training"]) == set()


def test_window_is_half_open_and_subjects_only_narrow(spark):
    events = [(101, t, ["analytics"]) for t in ("2023-12-31 23:59:59", "2024-01-01", "2024-01-02 23:59:59", "2024-01-03")]
    grants = [(1, "analytics", "2023-01-01", None)]
    assert read(spark, events, grants, ["analytics"]) == {1, 2}
    wide = spark.createDataFrame([(101,), (109,)], "subject_id long")
    assert read(spark, [*events, (109, "2024-01-02", ["analytics"])], grants, ["analytics"], wide) == {1, 2}
    assert read(spark, events, grants, ["analytics"], wide.where("subject_id = 109")) == set()


def test_arguments():
    for bad in ([], ["advertising"], ["analytics", "x"]):
        with pytest.raises(consent.ConsentPurposeError):
            consent.checked_purposes(bad)
    for ends in ((SINCE, SINCE), (UNTIL, SINCE), (datetime(2024, 1, 1), UNTIL)):
        with pytest.raises(consent.WindowError):
            consent.checked_window(*ends)


def test_pages_walk_every_row_once(spark):
    rows = spark.range(57).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id div 5)").alias("occurred_at"))
    seen, after = [], None
    while page := consent.keyset_page(rows, "event_id", after, 10).collect():
        seen += [r["event_id"] for r in page]
        after = (str(page[-1]["occurred_at"]), page[-1]["event_id"])
    assert seen == list(range(57))


def test_summary_has_null_candidate_sets_for_events(spark):
    e, _, _ = tables(spark, [(101, "2024-01-01 23:59", ["analytics"]), (101, "2024-01-02", ["analytics"])], [(1, "analytics", "2023-01-01", None)])
    i = e.select("subject_id", F.lit("p").alias("policy_id"), F.col("event_id").alias("candidate_set_id"), "occurred_at")
    got = {(str(r["summary_date"]), r["dimension"]): (r["record_count"], r["subject_count"], r["candidate_set_count"]) for r in consent.activity_summary(e, i).collect()}
    assert got == {(f"2024-01-0{d}", k): (1, 1, 1 if k == "policy_id" else None) for d in (1, 2) for k in ("event_type", "policy_id")}

import gzip
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestack.operators import consent
from lodestack.operators.graph import FastRP
from lodestack.plans import jobs, serve, status
from lodestack.sources import dumps, snapshots
from lodestack.sources.lens import Catalogue
from lodestack.sources.snapshots import Conflict, Published, ShortWalk, SnapshotStore
from lodestack.streaming import activity

from .conftest import SF


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def rows(spark, n, tag="x"):
    return spark.range(n).withColumn("tag", F.lit(tag))


def test_readers_keep_their_version(spark, store):
    assert store.read("a") is None and store.version() == 0
    store.publish({"a": rows(spark, 3), "b": rows(spark, 2)})
    pinned = store.read("a")
    store.publish({"a": rows(spark, 5, "y")})
    assert pinned.count() == 3 and store.read("a").count() == 5 and store.read("b").count() == 2
    assert store.read("a", 1).count() == 3


def test_empty_answers_and_short_walks_publish_nothing(spark, store):
    store.publish({"a": rows(spark, 3)})
    assert store.publish({"a": rows(spark, 0), "b": rows(spark, 1)}) == 1
    with pytest.raises(ShortWalk):
        store.publish({"a": rows(spark, 4)}, {"a": 5})
    assert store.version() == 1 and store.read("a").count() == 3
    assert store.publish({"a": rows(spark, 6)}, {"a": 5}) == 2  # it may have grown


def test_two_writers_cannot_both_commit(spark, store):
    store.publish({"a": rows(spark, 1)})
    store._commit({"a": store._write(rows(spark, 2), "a")}, 1)
    with pytest.raises(Conflict):
        store._commit({"a": store._write(rows(spark, 3), "a")}, 1)
    assert store.read("a").count() == 2


def test_windows_are_replaced_even_by_nothing(spark, store):
    d = spark.createDataFrame([(date(2024, 1, i), i) for i in range(1, 8)], "summary_date date, n int")
    store.publish({"s": d})
    store.replace_window("s", d.where("n = 5").withColumn("n", F.lit(50)), "summary_date", date(2024, 1, 4), date(2024, 1, 7))
    assert sorted(r["n"] for r in store.read("s").collect()) == [1, 2, 3, 7, 50]
    store.replace_window("s", d.limit(0), "summary_date", date(2024, 1, 1), date(2024, 2, 1))
    assert store.read("s").count() == 0


def test_upsert_keeps_what_is_never_updated(spark, store):
    t = "id string, y int, title string, release_year int, i int"
    go = lambda data: store.upsert("m", spark.createDataFrame(data, t), ["id", "y"], ["title"], "i")
    go([("a", 1, "old", 1990, 0), ("b", 1, "b", 1991, 0)])
    go([("a", 1, "mid", 2000, 0), ("a", 1, "new", 2001, 1), ("c", 1, "c1", 5, 0), ("c", 1, "c2", 6, 1)])
    assert {tuple(r) for r in store.read("m").select("id", "title", "release_year").collect()} == {("a", "new", 1990), ("b", "b", 1991), ("c", "c2", 5)}


def test_months_are_written_once(spark, store):
    make = lambda: spark.createDataFrame([(date(2024, 1, 1), 1)], "month date, n int")
    assert store.write_once("m", make, "month", date(2024, 1, 1)) == 1
    assert store.write_once("m", make, "month", date(2024, 1, 1)) == 0 and store.read("m").count() == 1
    with pytest.raises(ZeroDivisionError):
        store.write_once("m", lambda: 1 / 0, "month", date(2024, 2, 1))
    assert store.write_once("m", lambda: make().withColumn("month", F.lit(date(2024, 2, 1))), "month", date(2024, 2, 1)) == 1


def test_releases_rotate(spark, store):
    for v in ("v1", "v2", "v3"):
        store.write_release(rows(spark, 2, v), v, 50)
        assert store.registry().where("is_current").count() == (v != "v1")
        assert store.publish_release(v) == []
    kept = {r["model_version"]: r["is_current"] for r in store.registry().collect()}
    assert kept == {"v2": False, "v3": True}
    with pytest.raises(Published):
        store.write_release(rows(spark, 1), "v2", 50)
    with pytest.raises(KeyError):
        store.publish_release("v9")


def test_embeddings_are_loaded_once(spark, store):
    assert store.write_embeddings(rows(spark, 2), "m:edges-v3", "2024") == ("m:edges-v3@2024", True)
    assert store.write_embeddings(rows(spark, 9), "m:edges-v3", "2024") == ("m:edges-v3@2024", False)
    with pytest.raises(ValueError):
        store.write_embeddings(rows(spark, 2), "m", "a@b")


def test_cache_follows_the_version(spark, store):
    made = []

    def make(v):
        made.append(v)
        return store.read("a", v)

    store.publish({"a": rows(spark, 1)})
    assert store.cached("q", (1,), make).count() == store.cached("q", (1,), make).count() == 1 and made == [1]
    store.publish({"a": rows(spark, 2)})
    assert store.cached("q", (1,), make).count() == 2 and made == [1, 2]


def test_run_log_and_locks(spark, store):
    assert jobs.recorded(store, "ok", lambda: None) == "completed"
    assert "division" in jobs.recorded(store, "bad", lambda: 1 / 0)
    store.log("hung", "running", "r1")
    assert store.sweep() == 1 and store.sweep() == 0
    seen = {r["insight_type"]: r["status"] for r in serve.computation_status(store, ["ok", "bad", "new"], datetime(2030, 1, 1)).collect()}
    assert seen == {"ok": "completed", "bad": "failed", "new": "never_run"}
    assert {r["insight_type"]: r["status"] for r in store.runs().collect()} == {"ok": "completed", "bad": "failed", "hung": "interrupted"}
    assert store.lock("l") and not store.lock("l")
    store.unlock("l")
    assert store.lock("l")


def test_status_of_runs_and_latches(spark):
    log = spark.createDataFrame([(1, "a", "completed", "2024-01-01"), (2, "a", "running", "2024-01-02"), (3, "b", "running", "2024-01-01 20:00"), (4, "c", "failed", "2024-01-02")], "id int, insight_type string, status string, t string")
    log = log.withColumn("started_at", F.col("t").cast("timestamp_ntz"))
    got = {r["insight_type"]: r["status"] for r in status.latest(log, ["a", "b", "c", "d"], datetime(2024, 1, 2, 3)).collect()}
    assert got == {"a": "running", "b": "stale", "c": "failed", "d": "never_run"}
    latch = spark.createDataFrame([("x", "1", True, "2024-01-01", None), ("y", "1", True, "2023-12-01", "2024-01-01"), ("z", "1", True, "2023-12-01", None), ("w", "1", False, "2024-01-01", None)], "loader string, version string, open boolean, c string, r string")
    latch = latch.select("loader", "version", "open", F.col("c").cast("timestamp_ntz").alias("created_at"), F.col("r").cast("timestamp_ntz").alias("refreshed_at"))
    assert {r["loader"] for r in status.latches(latch, datetime(2024, 1, 2)).where("blocks").collect()} == {"x", "y"}


def test_computations_publish_and_are_served(spark, store):
    work = jobs.Jobs(spark, Catalogue(spark, SF), store, datetime(2024, 1, 27, 5))
    done = work.run()
    assert set(done.values()) == {"completed"} and tuple(done) == jobs.Jobs.NAMES
    assert work.run(("style_atlas",)) == {"style_atlas": "completed"}  # a second run in a month adds nothing
    sectors = store.read("genre_atlas_sectors")
    assert sectors.count() == sectors.select("genre").distinct().count()
    assert [r["rank"] for r in serve.top_artists(store, 5).collect()] == [1, 2, 3, 4, 5]
    rows, peak = serve.genre_trends(store, "STANDARD")
    assert peak in {r["decade"] for r in rows.collect()} and serve.genre_trends(store, "none")[1] is None
    assert serve.label_longevity(store, 5).count() == 5 and serve.label_longevity(store, 5, True).where("NOT is_placeholder").count() == 5
    assert serve.release_rarity(store, 3).count() == 3 and serve.data_completeness(store).count() == 4
    days = serve.activity_summary(store, date(2024, 1, 27)).select("summary_date").distinct().count()
    assert 1 <= days <= 7 and serve.style_cotags(store, "Brand#11").count() >= 0
    found = serve.style_atlas(store)
    span = found["timeline"]["last_year"] - found["timeline"]["first_year"] + 1
    styles = found["styles"].collect()
    assert found["month"] == date(2024, 1, 1) and styles and all(len(r["stages"]) == span for r in styles)
    assert found["genres"].count() == sectors.count() and found["ghosts"].count() > 0 and found["masters"].count() > 0
    later = jobs.Jobs(spark, Catalogue(spark, SF), store, datetime(2024, 2, 3))
    assert later.run(("style_atlas",)) == {"style_atlas": "completed"}
    both = store.read("genre_atlas_sectors").groupBy("genre").agg(F.countDistinct("sector_start", "sector_end").alias("n")).collect()
    assert {r["n"] for r in both} == {1}  # the ring is pinned
    for bad in (0, 501):
        with pytest.raises(ValueError):
            serve.top_artists(store, bad)
    assert jobs.Jobs(spark, None, store, datetime(2024, 1, 27)).run(("genre_trends", "community_enrichment"))["community_enrichment"] == "completed"


def test_similar_artists_job(spark, store):
    edges = spark.createDataFrame([("x", f"r:{i}", f"a:{(i * j) % 9}") for i in range(1, 30) for j in (1, 2)], "relation string, src string, dst string")
    small = FastRP(dim=8)
    assert jobs.similar_artists_job(store, edges, "d1", small, 3).exit_code == jobs.DONE
    assert len(serve.similar_artists(store, "a:1").first()["neighbours"]) == 3
    assert jobs.similar_artists_job(store, edges, "d1", small, 3).exit_code == jobs.DONE
    store.lock("similar-artists")
    assert jobs.similar_artists_job(store, edges, "d2", small, 3).exit_code == jobs.BUSY


RELEASES = """<releases>
<release id="1"><title>T</title><artists><artist><id>7</id><name>Ann</name></artist><artist><id>0</id><name>Various</name></artist></artists>
<extraartists><artist><id>8</id><name>Bob</name><role>Mixed By</role></artist></extraartists><labels><label id="5" name="L"/></labels>
<genres><genre>Rock</genre></genres><styles><style>Dub</style><style>Ska</style></styles><master_id>3</master_id>
<tracklist><track><position>A1</position><title>x</title><artists><artist><id>9</id><name>Ann</name></artist></artists>
<extraartists><artist><id></id><name>Cy</name><role>Design</role></artist></extraartists>
<sub_tracks><track><position>a</position><extraartists><artist><id>10</id><name>Dee</name><role>Vocals</role></artist></extraartists></track></sub_tracks></track></tracklist></release>
<release id="0"><title>none</title></release>
<release id="2"><title>U</title></release></releases>"""


def test_dumps_become_relations(spark, tmp_path):
    path = tmp_path / "releases.xml.gz"
    path.write_bytes(gzip.compress(RELEASES.encode()))
    records = dumps.releases(spark, str(path))
    assert {r["_id"] for r in records.collect()} == {"1", "2"}
    found = dumps.relations(records)
    get = lambda t, *c: {tuple(r) for r in found[t].select(*c).collect()}
    assert get("by_artist", "release_id", "artist_id") == {("1", "7")}
    assert get("on_label", "release_id", "label_id") == {("1", "5")}
    assert get("in_style", "release_id", "style") == {("1", "Dub"), ("1", "Ska")} and get("in_genre", "release_id", "genre") == {("1", "Rock")}
    assert get("derived_from", "release_id", "master_id") == {("1", "3")}
    assert get("credited_on", "person_name", "role_category") == {("Bob", "engineering")}
    assert get("track_credited_on", "person_name", "role_category", "track_ordinal", "sub_track_ordinal") == {("Cy", "design", 0, -1), ("Dee", "session", 0, 0)}
    assert get("track_by_artist", "artist_id", "track_position") == {("9", "A1")}
    assert {tuple(r) for r in dumps.same_as(records).collect()} == {("Ann", "7"), ("Ann", "9"), ("Bob", "8"), ("Dee", "10")}
    bad = tmp_path / "bad.xml"
    bad.write_text('<!DOCTYPE r [<!ENTITY a "b">]><releases></releases>')
    with pytest.raises(ValueError):
        dumps.releases(spark, str(bad))


def test_masters(spark, tmp_path):
    path = tmp_path / "masters.xml"
    path.write_text('<masters><master id="3"><title>M</title><year>1990</year><artists><artist><id>7</id><name>A</name></artist></artists><genres><genre>Rock</genre></genres></master></masters>')
    found = dumps.master_relations(dumps.masters(spark, str(path)))
    assert tuple(found["master_by_artist"].first()) == ("3", "7") and tuple(found["master_in_genre"].first()) == ("3", "Rock")


def test_stream_reaches_the_same_days_as_the_batch(spark, store, tmp_path):
    c = Catalogue(spark, SF)
    whole = c.events.select("event_id", "event_type", "subject_id", "occurred_at", "consent_purposes")
    for i in range(3):
        whole.where(F.least(F.floor((F.dayofmonth("occurred_at") - 1) / 10), F.lit(2)) == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    granted = lambda: consent.eligible_subjects(c.user_subjects, c.grants, ["analytics", "training"], datetime(2024, 1, 31))
    activity.publish_daily(stream, ["analytics", "training"], granted, store, str(tmp_path / "cp")).awaitTermination()
    got = {(r["summary_date"], r["dimension_key"]): (r["record_count"], r["subject_count"]) for r in store.read("activity_daily").collect()}
    agreed = whole.where(F.array_contains("consent_purposes", "analytics") & F.array_contains("consent_purposes", "training")).join(granted(), "subject_id", "left_semi")
    batch = agreed.groupBy(F.to_date("occurred_at").alias("d"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("s"))
    assert got and got == {(r["d"], r["event_type"]): (r["n"], r["s"]) for r in batch.collect()}
    again = activity.distinct_events(spark.readStream.schema(whole.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    q = again.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == whole.count()


def test_stream_counts_what_was_agreed_and_is_granted(spark, store, tmp_path):
    """All four cases of snapshot and grant, a revocation between two batches, and a delivery that is repeated."""
    row = "event_id long, event_type string, subject_id long, occurred_at timestamp_ntz, consent_purposes array<string>"
    put = lambda n, rows: spark.createDataFrame([(i, "view", s, datetime(2024, 1, d), p) for i, s, d, p in rows], row).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    table = lambda ids: spark.createDataFrame([(i,) for i in ids], "subject_id long")
    granted = [1, 2, 5]

    def run():
        stream = spark.readStream.schema(spark.createDataFrame([], row).schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        activity.publish_daily(stream, ["analytics"], lambda: table(granted), store, str(tmp_path / "cp")).awaitTermination()
        return {r["summary_date"].day: (r["record_count"], r["subject_count"]) for r in store.read("activity_daily").collect()}

    put(0, [(1, 1, 3, ["analytics"]), (2, 2, 3, []), (3, 3, 3, ["analytics"]), (4, 4, 3, ["training"]), (5, 5, 4, ["analytics"])])
    assert run() == {3: (1, 1), 4: (1, 1)}
    granted[:] = [1, 2]  # 5 revoked
    put(1, [(1, 1, 3, ["analytics"]), (6, 1, 3, ["analytics"]), (7, 2, 4, ["analytics"])])
    assert run() == {3: (2, 1), 4: (1, 1)}


def test_versions_are_seen_whole_and_locks_expire(spark, store):
    store.publish({"t": spark.range(3)})
    store.folder._fresh("drafts/half", "{")  # a writer that died before its rename
    store.folder._fresh("claims/versions/00000002")
    assert store.version() == 1 and store.read("t").count() == 3
    with pytest.raises(snapshots.Conflict):
        store.publish({"t": spark.range(4)})
    assert store.folder.create("versions/00000002", "{}", claim_s=-1) and not store.folder.exists("claims/versions/00000002")
    assert store.lock("l") and not store.lock("l") and store.lock("l", expires_s=-1) and not store.lock("l")


def test_upsert_keeps_null_keys(spark, store):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, first int")
    store.upsert("t", rows((None, 1, 1), ("a", 1, 1)), ["k"], ["v"])
    store.upsert("t", rows((None, 2, 2), ("b", 2, 2)), ["k"], ["v"])
    assert {tuple(r) for r in store.read("t").collect()} == {(None, 2, 1), ("a", 1, 1), ("b", 2, 2)}


def test_nightly_job_resolves_checks_pauses_and_resumes(spark, store):
    vectors = lambda n: spark.createDataFrame([(f"a{i}", [float((i * j) % 7 + 1) for j in range(4)]) for i in range(n)], "id string, embedding array<float>")
    assert jobs.similar_artists(store).status == "done"
    one, _ = store.write_embeddings(vectors(30), "m1", "d1")
    night = datetime(2024, 1, 2, tzinfo=timezone.utc)
    latch = lambda created: spark.createDataFrame([("x", "1", True, created, None)], "loader string, version string, open boolean, c string, r string").select(
        "loader", "version", "open", F.col("c").cast("timestamp_ntz").alias("created_at"), F.col("r").cast("timestamp_ntz").alias("refreshed_at"))
    got = jobs.similar_artists(store, latches=latch("2024-01-01 12:00"), now=night)
    assert (got.status, got.exit_code, got.decision) == ("skipped", jobs.DONE, "skip") and "being loaded" in got.reason
    got = jobs.similar_artists(store, latches=latch("2023-12-01"), check_only=True, now=night)
    assert (got.status, got.decision) == ("checked", "run") and "stale" in got.reason
    got = jobs.similar_artists(store, k=3, block=10, deadline=night, now=night)
    assert (got.status, got.exit_code, got.blocks_done, got.blocks_total) == ("paused", jobs.BUSY, 0, 3)
    assert jobs.similar_artists(store, deadline=datetime(2024, 1, 2)).exit_code == jobs.REFUSED
    assert jobs.similar_artists(store, "other").exit_code == jobs.REFUSED and jobs.similar_artists(store, max_runtime_s=0).exit_code == jobs.REFUSED
    store.write_embeddings(vectors(5), "m2", "d1")
    assert "2 versions" in jobs.similar_artists(store).error
    got = jobs.similar_artists(store, one, k=3, block=10)
    assert got.status == "done" and got.published and '"exit_code": 0' in got.to_json()
    assert jobs.similar_artists(store, one).already_published
    assert [r["model_version"] for r in store.published_versions().collect()] == [one]


def test_config_falls_back():
    from lodestack.plans.config import Config

    assert Config.from_env({}) == Config() and Config.from_env({"ENGINE_TOP_K": "x", "ENGINE_MILESTONES": "a,b"}) == Config()
    assert Config.from_env({"ENGINE_TOP_K": "9", "ENGINE_MILESTONES": "1, 2"}) == Config(top_k=9, milestones=(1, 2))

"""Registered queries over published snapshots: each publishes what it needs to a store of its own, then reads it as a user would."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import atlas, catalogue, consent, graph, lifecycle, neighbours
from lodestack.plans import registry, serve, status
from lodestack.sources.lens import Catalogue
from lodestack.sources.snapshots import ShortWalk, SnapshotStore
from lodestack.sources.storage import shared_dir

MONTH = date(2003, 1, 1)
LATCHES_AT = registry.datetime(2024, 1, 20)


def _store(spark: SparkSession) -> SnapshotStore:
    return SnapshotStore(spark, f"{shared_dir(spark)}/served/{uuid.uuid4().hex}")


def _published(spark: SparkSession, **tables: DataFrame) -> SnapshotStore:
    store = _store(spark)
    store.publish(tables)
    return store


def served_top_artists(spark, sf):
    return serve.top_artists(_published(spark, artist_centrality=registry.artist_centrality(spark, sf)), 25)


def served_genre_trends(spark, sf):
    store = _published(spark, genre_trends=registry.genre_trends(spark, sf))
    first = store.read("genre_trends").agg(F.min("genre")).first()[0]
    rows, peak = serve.genre_trends(store, first)
    return rows.withColumn("peak_decade", F.lit(peak).cast("int"))


def served_label_longevity(spark, sf):
    """Twenty real labels, with the placeholders that stand before the last of them."""
    return serve.label_longevity(_published(spark, label_longevity=registry.label_longevity_with_placeholders(spark, sf)), 20, placeholders=True)


def served_release_rarity(spark, sf):
    return serve.release_rarity(_published(spark, release_rarity=registry.release_rarity(spark, sf)), 50)


def release_rarity_parts(spark, sf):
    """The parts of each release's score, and its labels and artists as text."""
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return registry.release_rarity_full(spark, sf).select("release_id", "label_catalog", "temporal_scarcity", "graph_isolation", "collection_prevalence", ids("label_ids"), ids("artist_ids"))


def served_this_month(spark, sf):
    """Two months are published one after the other; a read sees the later one's rows only."""
    store, masters = _store(spark), Catalogue(spark, sf).masters
    for month in (2, 3):
        store.upsert("monthly_anniversaries", catalogue.anniversaries(masters, 2025, month), ["master_id", "computed_year", "computed_month"], ["title", "artist_name", "anniversary"])
    return serve.this_month(store, date(2025, 3, 15))


def served_data_completeness(spark, sf):
    return serve.data_completeness(_published(spark, data_completeness=registry.data_completeness(spark, sf)))


def served_activity_summary(spark, sf):
    """All events of ten days are published, then the last week again with consent alone: of that week nothing else stays. Five days
    are read."""
    c, store = Catalogue(spark, sf), _store(spark)
    every = c.events.select(F.col("subject_id")).distinct()
    who = consent.eligible_subjects(c.user_subjects, c.grants, ["analytics"], registry.NOW)
    for since, subjects in ((17, every), (20, who)):
        window = (["analytics"], registry.day(1, since), registry.day(1, 27))
        rows = consent.activity_summary(consent.consented(c.events, subjects, *window), consent.consented(c.impressions, subjects, *window))
        store.replace_window("activity_summary", rows, "summary_date", date(2024, 1, since), date(2024, 1, 27))
    return serve.activity_summary(store, date(2024, 1, 26), 9)


def served_style_cotags(spark, sf):
    store = _published(spark, style_cotags=catalogue.style_cotags(Catalogue(spark, sf).in_style))
    return serve.style_cotags(store, store.read("style_cotags").agg(F.min("style")).first()[0])


def served_style_atlas(spark, sf):
    """The styles of a published month, with stages derived on reading and parents as counts."""
    c = Catalogue(spark, sf)
    years, shares = graph.kept(registry.style_year_counts(spark, sf), "years"), graph.kept(registry.style_genre_shares(spark, sf), "shares")
    parents = catalogue.style_parents(shares, registry.FLOOR)
    grid = lifecycle.dense(years.select("style", F.col("year").alias("period"), F.col("release_count").alias("n")), MONTH.year - 1)
    sectors, nodes, _ = atlas.layout(parents, shares, lifecycle.emergence(lifecycle.stages(grid)))
    dated = lambda df: df.withColumn("month", F.lit(MONTH))
    store = _published(
        spark, genre_atlas_sectors=dated(sectors), style_atlas_layout=dated(nodes), style_year_counts=years, genre_year_counts=registry.genre_year_counts(spark, sf), style_parents=parents,
        style_landmark_masters=catalogue.style_landmarks(c.in_style, c.derived_from, c.masters),
    )
    later = F.size(F.filter("parents", lambda p: p["emergence_edge"])).cast("long")
    return serve.style_atlas(store)["styles"].select(
        "style", "genre", "stage", "settled_stage", "emergence_year", F.array_join(F.col("stages").cast("array<string>"), "").alias("stages"), F.size("parents").cast("long").alias("parents"), later.alias("later_than")
    )


def _keyed_events(spark, sf) -> DataFrame:
    key = F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    return Catalogue(spark, sf).table("events").select(key.alias("subject"), "event_type", F.col("event_id").alias("first_event"), F.col("event_id").alias("at"))


def snapshot_upsert(spark, sf):
    """Two batches of events by subject, null among them: the last event of a subject gives its type, the first its first_event."""
    store, rows = _store(spark), _keyed_events(spark, sf)
    for part in ("first_event % 3 = 0", "first_event % 3 = 1"):
        store.upsert("subjects", rows.where(part), ["subject"], ["event_type"], "at")
    return store.read("subjects")


def snapshot_replace(spark, sf):
    """Clicks are replaced by those of even ids; all else stays."""
    rows = Catalogue(spark, sf).table("events").select("event_id", "event_type")
    store = _published(spark, events=rows)
    store.replace_where("events", rows.where("event_type = 'click' AND event_id % 2 = 0"), "event_type = 'click'")
    return store.read("events")


def snapshot_once(spark, sf):
    """Each month is added once; a second write of the first month changes nothing."""
    store, trends = _store(spark), registry.genre_trends(spark, sf)
    for month, factor in ((1, 1), (2, 2), (1, 3)):
        value = date(2024, month, 1)
        store.write_once("monthly", lambda: trends.select("genre", "decade", (F.col("release_count") * factor).alias("release_count"), F.lit(value).alias("month")), "month", value)  # noqa: B023
    return store.read("monthly")


def snapshot_pair(spark, sf):
    """Two tables that are replaced together; an empty first table and a short walk change neither."""
    c = Catalogue(spark, sf)
    small, large = c.table("nation").select("n_nationkey", "n_name"), c.table("region").select("r_regionkey", "r_name")
    store = _published(spark, nations=small, regions=large)
    store.publish({"nations": small.where("false"), "regions": large.where("r_regionkey > 1")})
    try:
        store.publish({"nations": small.where("n_nationkey < 5")}, expected={"nations": 25})
    except ShortWalk:
        pass
    seen = store.version()
    return store.read("nations", seen).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).union(store.read("regions", seen))


def embeddings_read_back(spark, sf):
    """Vectors of a model and dump, which a second write under the same name doesn't change, read in order of their ids."""
    store, vectors = _store(spark), Catalogue(spark, sf).embeddings.select("id", "embedding")
    store.write_embeddings(vectors.where("id % 2 = 0"), "method", "d1")
    store.write_embeddings(vectors, "method", "d1")
    name, _ = store.write_embeddings(vectors.where("id % 2 = 1"), "method", "d2")
    known = store.embedding_versions()
    rows = store.read(known["method@d1"]).unionByName(store.read(known[name]))
    return rows.orderBy("id").select("id", "model_version", F.size("embedding").cast("long").alias("dim"), F.col("embedding")[0].cast("double").alias("first_value"))


def served_similar_artists(spark, sf):
    """The list of one artist in the current release, after three were published in turn and a fourth was only written."""
    store, top = _store(spark), neighbours.exact_top_k(Catalogue(spark, sf).embeddings, 10)
    lists = graph.kept(neighbours.neighbour_lists(top))
    for version, keep in (("v1", "false"), ("v2", "id < '5'"), ("v3", "true"), ("v4", "false")):
        store.write_release(lists.where(keep), version, 10)
        if version != "v4":
            store.publish_release(version)
    artist = store.read(store.registry().where("is_current").first()["place"]).agg(F.min("id")).first()[0]
    return serve.similar_artists(store, artist).select("id", F.array_join("neighbours", ",").alias("neighbours"))


def release_rotation(spark, sf):
    """Published versions, the latest first: the current one and that which it displaced, with the number of their queries."""
    store, ids = _store(spark), Catalogue(spark, sf).embeddings.select(F.col("id").cast("string").alias("id"))
    for version, keep in (("v1", "true"), ("v2", "id < '5'"), ("v3", "id < '3'")):
        store.write_release(ids.where(keep), version, 10)
        store.publish_release(version)
    sizes = [(r["model_version"], store.read(r["place"]).count()) for r in store.registry().collect()]  # two releases
    return store.published_versions().join(spark.createDataFrame(sizes, "model_version string, queries long"), "model_version").select("model_version", "is_current", "queries")


def run_log(spark, sf):
    """The state of each run after a restart: what was still running was interrupted."""
    store = _store(spark)
    for kind, *states in (("genre_trends", "running", "completed"), ("style_atlas", "running"), ("label_longevity", "running", "failed")):
        for state in states:
            store.log(kind, state, kind, 3 if state == "completed" else None, "no rows" if state == "failed" else None)
    store.sweep()
    return store.runs().select("insight_type", "status", "rows_affected", "error_message")


def load_latches(spark, sf):
    """Events as latches of loaders: open ones of views, refreshed if the id is even."""
    e = Catalogue(spark, sf).table("events")
    rows = e.select(
        F.col("event_type").alias("loader"), F.col("event_id").cast("string").alias("version"), (F.col("event_type") == "view").alias("open"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 3 DAYS")).alias("refreshed_at"),
    )
    return status.latches(rows, LATCHES_AT)


def recall_by_degree(spark, sf):
    truth, found = registry._two_releases(spark, sf)
    orders = Catalogue(spark, sf).table("orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count("*").alias("degree"))
    return neighbours.recall_by_degree(neighbours.recall_at(found, truth), orders)


def reranked_neighbours(spark, sf):
    """The first ten by exact cosine of over-fetched pairs in no order."""
    vectors = Catalogue(spark, sf).embeddings
    pairs = neighbours.exact_top_k(vectors, 50).where((F.col("id").cast("int") + F.col("neighbour").cast("int")) % 5 != 0).select("id", "neighbour")
    return neighbours.reranked(pairs, vectors, 10).withColumn("score", F.round("score", 6))


def zero_filled_vectors(spark, sf):
    c = Catalogue(spark, sf)
    rows = neighbours.zero_filled(c.table("customer").select(F.col("c_custkey").alias("id")), c.embeddings.where("id % 3 = 0").select("id", "embedding"), 64)
    return rows.select("id", F.size("embedding").cast("long").alias("dim"), F.col("embedding")[0].cast("double").alias("first_value"))


QUERIES = (
    served_top_artists, served_genre_trends, served_label_longevity, served_release_rarity, release_rarity_parts, served_this_month, served_data_completeness,
    served_activity_summary, served_style_cotags, served_style_atlas, snapshot_upsert, snapshot_replace, snapshot_once, snapshot_pair, embeddings_read_back,
    served_similar_artists, release_rotation, run_log, load_latches, recall_by_degree, reranked_neighbours, zero_filled_vectors,
)

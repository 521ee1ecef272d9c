"""Queries of the catalogue engine by name, each over the whole tables of a folder, and their SQL for comparison."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import atlas, catalogue, consent, graph, lifecycle, neighbours, rarity
from lodestack.plans import catalogue_sql, served_sql, status
from lodestack.sources.lens import Catalogue

NOW = datetime(2024, 1, 31)
#: All shares of the test catalogue exceed the production floor of 0.20, so its queries use one that cuts.
FLOOR = 0.565
LAST_PERIOD = 79


def day(month: int, number: int) -> datetime:
    return datetime(2024, month, number, tzinfo=timezone.utc)


def _shares(c: Catalogue) -> DataFrame:
    return catalogue.style_genre_shares(c.in_style, c.in_genre)


def _parents(c: Catalogue) -> DataFrame:
    return catalogue.style_parents(_shares(c), FLOOR)


def _grid(c: Catalogue) -> DataFrame:
    """Styles by month: the test catalogue spans too few years for the rule's ten."""
    dated = c.releases.where("year IS NOT NULL").select("release_id", ((F.col("year") - 1995) * 12 + F.col("month") - 1).cast("int").alias("period"))
    pairs = c.in_style.distinct().join(dated, "release_id")
    return lifecycle.dense(pairs.groupBy("style", "period").agg(F.count("*").alias("n")), LAST_PERIOD)


def genre_trends(spark: SparkSession, sf: str) -> DataFrame:
    c = Catalogue(spark, sf)
    return catalogue.genre_trends(c.releases, c.in_genre)


def genre_peak_decade(spark, sf):
    return catalogue.peak_decades(genre_trends(spark, sf))


def artist_centrality(spark, sf):
    c = Catalogue(spark, sf)
    return catalogue.artist_centrality(c.artists, c.by_artist)


def style_year_counts(spark, sf):
    c = Catalogue(spark, sf)
    return catalogue.style_year_counts(c.releases, c.in_style, c.derived_from)


def genre_year_counts(spark, sf):
    c = Catalogue(spark, sf)
    return catalogue.genre_year_counts(c.releases, c.in_genre)


def style_genre_shares(spark, sf):
    return _shares(Catalogue(spark, sf))


def style_parents(spark, sf):
    return _parents(Catalogue(spark, sf))


def style_landmarks(spark, sf):
    c = Catalogue(spark, sf)
    return catalogue.style_landmarks(c.in_style, c.derived_from, c.masters)


def style_cotags(spark, sf):
    return catalogue.style_cotags(Catalogue(spark, sf).in_style, 10)


def label_longevity(spark, sf):
    return label_longevity_with_placeholders(spark, sf).where("NOT is_placeholder")


def label_longevity_with_placeholders(spark, sf):
    c = Catalogue(spark, sf)
    return catalogue.label_longevity(c.releases, c.on_label, c.labels, 2001)


def anniversaries(spark, sf):
    return catalogue.anniversaries(Catalogue(spark, sf).masters, 2025, 3)


def data_completeness(spark, sf):
    return catalogue.data_completeness(Catalogue(spark, sf))


def _signals(c: Catalogue) -> DataFrame:
    return rarity.quality_signals(c.releases, c.by_artist, c.on_label, c.in_genre)


def rarity_quality_counts(spark, sf):
    return rarity.quality_counts(_signals(Catalogue(spark, sf)))


def rarity_scarcity(spark, sf):
    return rarity.scarcity(rarity_quality_counts(spark, sf))


def release_rarity(spark, sf):
    c = Catalogue(spark, sf)
    return rarity.release_rarity(c.releases, _signals(c), c.by_artist, c.on_label).select("release_id", "year", "rarity_score", "tier", "hidden_gem_score")


def release_rarity_full(spark, sf):
    c = Catalogue(spark, sf)
    return rarity.release_rarity(c.releases, _signals(c), c.by_artist, c.on_label)


def eligible_subjects(spark, sf):
    c = Catalogue(spark, sf)
    return consent.eligible_subjects(c.user_subjects, c.grants, ["analytics", "training"], NOW)


def consented_events(spark, sf):
    c = Catalogue(spark, sf)
    both = ["analytics", "training"]
    found = consent.consented(c.events, eligible_subjects(spark, sf), both, day(1, 5), day(1, 20))
    return found.select("event_id", "event_type", "subject_id", "occurred_at")


def consented_impressions(spark, sf):
    c = Catalogue(spark, sf)
    who = consent.eligible_subjects(c.user_subjects, c.grants, ["analytics"], NOW)
    found = consent.consented(c.impressions, who, ["analytics"], day(1, 5), day(1, 20), ("policy_id", ["policy-1", "policy-3"]))
    return found.select("impression_id", "subject_id", "policy_id", "candidate_set_id", "occurred_at")


def events_keyset_page(spark, sf):
    return consent.keyset_page(Catalogue(spark, sf).events, "event_id", ("2024-01-10 00:00:00", 0), 500).select("event_id", "occurred_at", "event_type")


def activity_summary(spark, sf):
    c = Catalogue(spark, sf)
    who = consent.eligible_subjects(c.user_subjects, c.grants, ["analytics"], NOW)
    window = (["analytics"], day(1, 20), day(1, 27))
    return consent.activity_summary(consent.consented(c.events, who, *window), consent.consented(c.impressions, who, *window))


def style_emergence(spark, sf):
    return lifecycle.emergence(style_lifecycle_stages(spark, sf))


def style_lifecycle_stages(spark, sf):
    return lifecycle.stages(_grid(Catalogue(spark, sf)))


def lifecycle_flip_share(spark, sf):
    grid = _grid(Catalogue(spark, sf))
    return lifecycle.flip_share(lifecycle.stages(grid), lifecycle.stages(grid, lifecycle.RULE.perturbed(1.1)["active_share"]))


def genre_affinity(spark, sf):
    return atlas.genre_affinity(_shares(Catalogue(spark, sf))).withColumn("affinity", F.round("affinity", 6))


def atlas_members(spark, sf):
    return atlas.members(_parents(Catalogue(spark, sf)))


def atlas_ranks(spark, sf):
    """Ranks in a ring by name; the exact ring is that of atlas_layout."""
    c = Catalogue(spark, sf)
    names = sorted(r[0] for r in _shares(c).select("genre").distinct().collect())
    return atlas.ranked(_parents(c), _shares(c), style_emergence(spark, sf), atlas.ring_table(spark, names))


def _drawn(c: Catalogue, emergence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents, shares and emergence of a layout, which reads them several times; shares are a row for each style and genre."""
    shares = graph.kept(_shares(c), "shares")
    return catalogue.style_parents(shares, FLOOR), shares, graph.kept(emergence, "emergence")


def atlas_layout(spark, sf):
    return atlas.layout(*_drawn(Catalogue(spark, sf), style_emergence(spark, sf)))[1]


def atlas_sectors(spark, sf):
    return atlas.layout(*_drawn(Catalogue(spark, sf), style_emergence(spark, sf)))[0]


def atlas_movement(spark, sf):
    """Against a layout of all shares at the production floor."""
    parents, shares, emergence = _drawn(Catalogue(spark, sf), style_emergence(spark, sf))
    before = atlas.layout(catalogue.style_parents(shares), shares, emergence)[1]
    return atlas.movement(graph.kept(before, "layout"), graph.kept(atlas.layout(parents, shares, emergence)[1], "layout"))


def atlas_hull_check(spark, sf):
    parents, shares, emergence = _drawn(Catalogue(spark, sf), style_emergence(spark, sf))
    return atlas.hull_check(graph.kept(atlas.layout(parents, shares, emergence)[1], "layout"), parents)


def credited_artist_edges(spark, sf):
    c = Catalogue(spark, sf)
    return graph.credited_artists(c.credited_on, c.same_as)


def discovered_releases(spark, sf):
    return graph.discovered_releases(Catalogue(spark, sf).credited_on)


def edge_report(spark, sf):
    return graph.relations_of(Catalogue(spark, sf)).report()


def vertex_counts(spark, sf):
    c = Catalogue(spark, sf)
    return graph.relations_of(c).vertices(graph.catalogue_releases(c)).groupBy("kind").agg(F.count("*").alias("vertices"))


def vertex_degree(spark, sf):
    return graph.relations_of(Catalogue(spark, sf)).degrees()


def transition_weights(spark, sf):
    return graph.relations_of(Catalogue(spark, sf)).transitions()


def degree_buckets(spark, sf):
    return vertex_degree(spark, sf).groupBy(neighbours.degree_bucket(F.col("degree")).alias("bucket")).agg(F.count("*").alias("vertices"))


def node_keys(spark, sf):
    return graph.with_distinct_keys(graph.kept(graph.keyed(graph.relations_of(Catalogue(spark, sf)).vertices())))


def fastrp_embeddings(spark, sf):
    c = graph.lines_stored(Catalogue(spark, sf))
    vectors = graph.fastrp_of(graph.relations_of(c, stored=True), lambda: graph.catalogue_edges(c), kinds=("a",), known={"r": graph.named_releases(c)})
    return neighbours.half_precision(vectors.withColumnRenamed("vertex", "id"))


def exact_top_k(spark, sf):
    top = neighbours.exact_top_k(Catalogue(spark, sf).embeddings, 10)
    return top.withColumn("score", F.round("score", 6))


def similar_lists(spark, sf):
    return neighbours.neighbour_lists(neighbours.exact_top_k(Catalogue(spark, sf).embeddings, 50))


def _two_releases(spark, sf):
    """The first ten exact neighbours, and those of an index that lost every fifth pair of the first fifty."""
    every = neighbours.exact_top_k(Catalogue(spark, sf).embeddings, 50)
    from pyspark.sql import Window

    lost = every.where((F.col("id").cast("int") + F.col("neighbour").cast("int")) % 5 != 0)
    lost = lost.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")))
    return every.where("rank <= 10"), lost.where("rank <= 10")


def top_k_recall(spark, sf):
    truth, found = _two_releases(spark, sf)
    return neighbours.recall_at(found, truth)


def churn_jaccard(spark, sf):
    return neighbours.churn(*_two_releases(spark, sf))


def duplicate_vectors(spark, sf):
    e = Catalogue(spark, sf).embeddings
    return neighbours.duplicate_groups(e.select("embedding").union(e.where("id % 3 = 0").select("embedding")))


def embedding_coverage(spark, sf):
    c = Catalogue(spark, sf)
    return neighbours.coverage(c.table("customer").select(F.col("c_custkey").alias("id")), c.embeddings)


def recall_interval(spark, sf):
    return neighbours.bootstrap(top_k_recall(spark, sf), "strict")


def latency_percentiles(spark, sf):
    return neighbours.percentiles(Catalogue(spark, sf).table("events"), "value")


def hash_sample(spark, sf):
    return neighbours.hash_sample(Catalogue(spark, sf).embeddings, "id", 100).select("id", "label")


def computation_status(spark, sf):
    """The status of a log made of events: event types are computations, the id tells how a run ended."""
    e = Catalogue(spark, sf).table("events")
    state = F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "running").otherwise("failed")
    log = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("insight_type"), state.alias("status"), F.col("ts").alias("started_at"))
    return status.latest(log, ["click", "view", "purchase", "signup", "error", "refund"], datetime(2024, 1, 30, 12))


def unpublished_versions(spark, sf):
    """Versions of the vectors, with their numbers, that no registry row publishes."""
    versions = Catalogue(spark, sf).embeddings.groupBy(F.concat(F.lit("v"), F.col("label").cast("string")).alias("model_version")).agg(F.count("*").alias("vectors"))
    return versions.join(spark.createDataFrame([("v0",), ("v3",)], "model_version string"), "model_version", "left_anti")


QUERIES = (
    genre_trends, genre_peak_decade, artist_centrality, style_year_counts, genre_year_counts, style_genre_shares, style_parents, style_landmarks, style_cotags,
    label_longevity, label_longevity_with_placeholders, anniversaries, data_completeness, rarity_quality_counts, rarity_scarcity, release_rarity,
    release_rarity_full, eligible_subjects, consented_events, consented_impressions, events_keyset_page, activity_summary, style_emergence,
    style_lifecycle_stages, lifecycle_flip_share, genre_affinity, atlas_members, atlas_ranks, atlas_layout, atlas_sectors, atlas_movement, atlas_hull_check,
    credited_artist_edges, discovered_releases, edge_report, vertex_counts, vertex_degree, transition_weights, degree_buckets, node_keys, fastrp_embeddings,
    exact_top_k, similar_lists, top_k_recall, churn_jaccard, duplicate_vectors, embedding_coverage, recall_interval, latency_percentiles, hash_sample,
    computation_status, unpublished_versions,
)


def queries() -> dict:
    from lodestack.plans import served  # which builds on the queries above

    return {f.__name__: f for f in (*QUERIES, *served.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return catalogue_sql.oracle_sql() | served_sql.oracle_sql()

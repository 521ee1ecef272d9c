"""Reads over published snapshots: the query surface. Each takes a store, checks its arguments, and reads one pinned version."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators import catalogue, lifecycle
from lodestack.plans import status
from lodestack.sources.snapshots import SnapshotStore


def _bounded(name: str, value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be 1 to {most}")
    return value


def _table(store: SnapshotStore, name: str, version: int) -> DataFrame:
    found = store.read(name, version)
    if found is None:
        raise LookupError(f"{name} has not been published")
    return found


def top_artists(store: SnapshotStore, limit: int = 100) -> DataFrame:
    _bounded("limit", limit, 500)
    return store.cached("top_artists", (limit,), lambda v: _table(store, "artist_centrality", v).orderBy("rank").limit(limit))


def genre_trends(store: SnapshotStore, genre: str) -> tuple[DataFrame, int | None]:
    """The decades of a genre, and its peak: the earliest decade of most releases; None if the genre is unknown."""
    rows = _table(store, "genre_trends", store.version()).where(F.col("genre") == genre).orderBy("decade")
    peak = catalogue.peak_decades(rows).first()
    return rows, peak["peak_decade"] if peak else None


def label_longevity(store: SnapshotStore, limit: int = 50, placeholders: bool = False) -> DataFrame:
    """The first labels by rank; with placeholders, also those that stand before the limit-th real label in ranking order."""
    _bounded("limit", limit, 200)
    rows = _table(store, "label_longevity", store.version())
    if not placeholders:
        return rows.where("NOT is_placeholder").orderBy("rank").limit(limit)
    rows = rows.where((F.col("rank") <= limit) | F.col("is_placeholder"))
    order = Window.orderBy(F.desc("years_active"), F.desc("total_releases"), "label_id")  # at most two limits of rows
    placed = rows.withColumn("_at", F.row_number().over(order))
    last = F.max(F.when(~F.col("is_placeholder"), F.col("_at"))).over(Window.partitionBy())
    real = F.sum(F.when(F.col("is_placeholder"), 0).otherwise(1)).over(Window.partitionBy())
    return placed.withColumns({"_last": last, "_real": real}).where((F.col("_real") < limit) | (F.col("_at") <= F.col("_last"))).orderBy("_at").drop("_at", "_last", "_real")


def release_rarity(store: SnapshotStore, limit: int = 50) -> DataFrame:
    _bounded("limit", limit, 500)
    return _table(store, "release_rarity", store.version()).orderBy(F.desc("rarity_score"), "release_id").limit(limit)


def this_month(store: SnapshotStore, today: date) -> DataFrame:
    rows = _table(store, "monthly_anniversaries", store.version())
    return rows.where((F.col("computed_year") == today.year) & (F.col("computed_month") == today.month)).orderBy(F.desc("anniversary"), "release_year")


def data_completeness(store: SnapshotStore) -> DataFrame:
    return _table(store, "data_completeness", store.version()).orderBy("entity_type")


def activity_summary(store: SnapshotStore, today: date, days: int = 7) -> DataFrame:
    _bounded("days", days, 90)
    rows = _table(store, "activity_summary", store.version())
    return rows.where(F.col("summary_date") >= F.lit(today - timedelta(days=days - 1))).orderBy(F.desc("summary_date"), "dimension", "dimension_key")


def style_cotags(store: SnapshotStore, style: str) -> DataFrame:
    return _table(store, "style_cotags", store.version()).where(F.col("style") == style).orderBy("rank").limit(25)


def similar_artists(store: SnapshotStore, artist: str) -> DataFrame:
    """The list of an artist in the current release."""
    version = store.version()
    current = _table(store, "registry", version).where("is_current").first()
    if current is None:
        raise LookupError("no release is published")
    return _table(store, current["place"], version).where(F.col("id") == artist)


def emerges_after(a, b):
    """Whether a style emerged after its genre; both must have emerged."""
    return F.coalesce(a > b, F.lit(False))


def style_atlas(store: SnapshotStore, rule: lifecycle.Rule = lifecycle.RULE) -> dict:
    """The latest month's atlas: month, rule, timeline, and DataFrames of genres, styles, ghosts and masters. Stages are derived on
    reading, from the counts up to the last complete year."""
    version = store.version()
    sectors = store.read("genre_atlas_sectors", version)
    month = sectors.agg(F.max("month")).first()[0] if sectors is not None else None
    if month is None:
        return {"month": None, "rule": rule.describe(), "timeline": None, "genres": None, "styles": None, "ghosts": None, "masters": None}
    last = month.year - 1
    counts = lambda t, key: _table(store, t, version).select(F.col(key).alias("style"), F.col("year").alias("period"), F.col("release_count").alias("n"))
    staged = lifecycle.stages(lifecycle.dense(counts("style_year_counts", "style"), last), rule)
    genre_staged = lifecycle.stages(lifecycle.dense(counts("genre_year_counts", "genre"), last), rule)
    born, genre_born = lifecycle.emergence(staged), lifecycle.emergence(genre_staged).select(F.col("style").alias("genre"), F.col("emergence").alias("genre_emergence"))
    span = staged.agg(F.min("period").alias("first")).first()["first"]
    settled = last - rule.provisional_years
    nodes = _table(store, "style_atlas_layout", version).where(F.col("month") == F.lit(month))
    timeline = F.transform(F.array_sort(F.collect_list(F.struct("period", "stage"))), lambda x: x["stage"])
    lines = staged.groupBy("style").agg(
        timeline.alias("stages"), F.max_by("stage", "period").alias("stage"), F.max(F.when(F.col("period") == settled, F.col("stage"))).alias("settled"), F.min("emergence").alias("emergence_year")
    )
    parents = _table(store, "style_parents", version).join(born, "style", "left").join(genre_born, "genre", "left")
    edge = emerges_after(F.col("emergence"), F.col("genre_emergence"))
    parents = parents.groupBy("style").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("order"), "genre", "share", "is_dominant", edge.alias("emergence_edge")))).alias("parents")
    )
    # A style without dated releases is absent throughout.
    none = F.array_repeat(F.lit(0), last - span + 1) if span is not None else F.array().cast("array<int>")
    styles = nodes.where("node_kind = 'style'").join(lines, "style", "left").join(parents, "style", "left")
    named = lambda c: lifecycle.stage_name(F.coalesce(F.col(c), F.lit(0)))
    styles = styles.select("style", "genre", "x", "y", named("stage").alias("stage"), F.when(F.lit(span is not None and settled >= (span or 0)), named("settled")).alias("settled_stage"), "emergence_year", F.coalesce("stages", none).alias("stages"), "parents")
    landmarks = _table(store, "style_landmark_masters", version).join(nodes.where("node_kind = 'style'").select("style"), "style", "left_semi")
    here = sectors.where(F.col("month") == F.lit(month)).join(genre_born, "genre", "left").withColumnRenamed("genre_emergence", "emergence_year")
    return {
        "month": month, "rule": rule.describe(), "timeline": {"first_year": span, "last_year": last, "provisional_from": last - rule.provisional_years + 1},
        "genres": here.orderBy("ring_order"), "styles": styles.orderBy("style"), "ghosts": nodes.where("node_kind = 'ghost'").select("style", "genre", "x", "y").orderBy("style", "genre"),
        "masters": landmarks.orderBy("style", "rank"),
    }


def computation_status(store: SnapshotStore, kinds: list[str], now: datetime) -> DataFrame:
    """The status of every computation; never_run for those that the log doesn't know."""
    runs = store.runs()
    if runs is None:
        runs = store.spark.createDataFrame([], "id string, insight_type string, status string, started_at timestamp_ntz")
    return status.latest(runs, kinds, now)

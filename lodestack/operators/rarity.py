"""Rarity: how uncommon a release's signals are among all releases.

The formula is this engine's own definition. Signals are counted once over all releases; a value's score is the share of
releases with a larger value, so the merge of partial counts is a sum and scoring is a join on the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = ("artist", "label", "genre")
#: Equal weights for the media-neutral core; the deprecated format signal stays at weight 0.
WEIGHTS = {"label_catalog": 0.25, "temporal_scarcity": 0.25, "graph_isolation": 0.25, "collection_prevalence": 0.25, "format_rarity": 0.0}
#: Lower edges of the tiers, highest first.
TIERS = ((0.9, "ultra-rare"), (0.75, "rare"), (0.5, "uncommon"))


def quality_signals(releases: DataFrame, by_artist: DataFrame, on_label: DataFrame, in_genre: DataFrame) -> DataFrame:
    """(release_id, artist, label, genre): the degree of the best-connected artist, label and genre of each release; 0 if none."""
    out = releases.select("release_id")
    for pairs, key, name in ((by_artist, "artist_id", "artist"), (on_label, "label_id", "label"), (in_genre, "genre", "genre")):
        edges = pairs.select("release_id", F.col(key).alias("k")).distinct()
        degree = edges.groupBy("k").agg(F.count("*").alias("d"))
        best = edges.join(degree, "k").groupBy("release_id").agg(F.max("d").alias(f"{name}_best"))
        out = out.join(best, "release_id", "left")
    return out.select("release_id", *[F.coalesce(f"{s}_best", F.lit(0)).alias(s) for s in SIGNALS])


def quality_counts(signals: DataFrame) -> DataFrame:
    """(signal, value, releases): how many releases have each value; counts of pages or parts add up by summing."""
    stack = ", ".join(f"'{s}', {s}" for s in SIGNALS)
    return signals.selectExpr(f"stack({len(SIGNALS)}, {stack}) AS (signal, value)").groupBy("signal", "value").agg(F.count("*").alias("releases"))


def scarcity(counts: DataFrame) -> DataFrame:
    """(signal, value, score): the share of releases with a larger value of the signal. A window over distinct values, not rows."""
    above = Window.partitionBy("signal").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("releases").over(Window.partitionBy("signal"))
    return counts.select("signal", "value", (F.coalesce(F.sum("releases").over(above), F.lit(0)) / total).alias("score"))


def tier(score: Column) -> Column:
    out = F.lit("common")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def release_rarity(releases: DataFrame, signals: DataFrame, by_artist: DataFrame, on_label: DataFrame) -> DataFrame:
    """One row for each release with its scores. Of a kind without the data here (media families), signals are null or empty;
    label_ids and artist_ids are ascending and empty, not null, if there are none."""
    score = scarcity(quality_counts(signals))
    of = lambda s: score.where(F.col("signal") == s).select(F.col("value").alias(s), F.col("score").alias(f"{s}_score"))
    rows = releases.select("release_id", "year").join(signals, "release_id")
    for s in SIGNALS:
        rows = rows.join(of(s), s)
    years = releases.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("of_year"))
    older = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    years = years.withColumn("old", 1 - F.sum("of_year").over(older) / F.sum("of_year").over(Window.partitionBy())).select("year", "old")
    rows = rows.join(years, "year", "left")
    ids = lambda pairs, key, out: pairs.groupBy("release_id").agg(F.array_sort(F.collect_set(key)).alias(out))
    rows = rows.join(ids(on_label, "label_id", "label_ids"), "release_id", "left").join(ids(by_artist, "artist_id", "artist_ids"), "release_id", "left")
    parts = {
        "label_catalog": F.col("label_score"), "temporal_scarcity": F.coalesce("old", F.lit(0.0)), "graph_isolation": F.col("artist_score"),
        "collection_prevalence": F.col("genre_score"), "format_rarity": F.lit(0.0),
    }
    rows = rows.withColumns(parts)
    total = sum((F.col(n) * w for n, w in WEIGHTS.items() if w), F.lit(0.0))
    rows = rows.withColumn("rarity_score", F.round(total, 9))
    none = F.array().cast("array<bigint>")
    return rows.select(
        F.col("release_id").cast("string").alias("release_id"), "year", "rarity_score", tier(F.col("rarity_score")).alias("tier"),
        F.round(F.col("rarity_score") * (1 - F.col("graph_isolation")), 9).alias("hidden_gem_score"), F.lit(None).cast("double").alias("pressing_scarcity"),
        *[F.round(n, 9).alias(n) for n in parts], F.lit(None).cast("double").alias("medium_rarity"), F.array().cast("array<string>").alias("media_families"),
        F.create_map().cast("map<string,map<string,double>>").alias("family_signals"), F.coalesce("label_ids", none).alias("label_ids"), F.coalesce("artist_ids", none).alias("artist_ids"),
    )

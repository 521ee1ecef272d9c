"""Catalogue aggregates. Every count is of distinct releases (or masters): pairs are made distinct first, on both keys, so
that the count behind it is a plain partial aggregate and no hot style or genre gathers its releases in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def count_distinct(pairs: DataFrame, by: list[str], what: str, out: str) -> DataFrame:
    return pairs.select(*by, what).distinct().groupBy(*by).agg(F.count(what).alias(out))


def genre_trends(releases: DataFrame, in_genre: DataFrame) -> DataFrame:
    """(genre, decade, release_count) by the releases' own years; undated ones are left out."""
    dated = releases.where("year IS NOT NULL").select("release_id", decade(F.col("year")).alias("decade"))
    return count_distinct(in_genre.join(dated, "release_id"), ["genre", "decade"], "release_id", "release_count")


def peak_decades(trends: DataFrame) -> DataFrame:
    """(genre, peak_decade, total): the decade of most releases, the earlier one of equals."""
    best = F.max_by("decade", F.struct("release_count", -F.col("decade")))
    return trends.groupBy("genre").agg(best.alias("peak_decade"), F.sum("release_count").alias("total"))


def artist_centrality(artists: DataFrame, by_artist: DataFrame, limit: int = 100) -> DataFrame:
    """(rank, artist_id, artist_name, edge_count): the most connected artists with a name; names are checked before ranking."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    named = artists.where("artist_name IS NOT NULL AND artist_name <> ''")
    edges = count_distinct(by_artist, ["artist_id"], "release_id", "edge_count")
    best = edges.join(named, "artist_id").withColumn("artist_id", F.col("artist_id").cast("string"))
    best = best.orderBy(F.desc("edge_count"), "artist_id").limit(limit)
    return best.select(F.row_number().over(Window.orderBy(F.desc("edge_count"), "artist_id")).alias("rank"), "artist_id", "artist_name", "edge_count")


def style_year_counts(releases: DataFrame, in_style: DataFrame, derived_from: DataFrame) -> DataFrame:
    """(style, year, release_count, master_count); releases without a master add none."""
    tagged = in_style.distinct().join(releases.where("year IS NOT NULL").select("release_id", "year"), "release_id")
    tagged = tagged.join(derived_from, "release_id", "left")
    # Once for each style, year and master, then once for each style and year: a skewed style is cut by its masters.
    parts = tagged.groupBy("style", "year", "master_id").agg(F.countDistinct("release_id").alias("n"))
    return parts.groupBy("style", "year").agg(F.sum("n").alias("release_count"), F.count("master_id").alias("master_count"))


def genre_year_counts(releases: DataFrame, in_genre: DataFrame) -> DataFrame:
    dated = releases.where("year IS NOT NULL").select("release_id", "year")
    return count_distinct(in_genre.join(dated, "release_id"), ["genre", "year"], "release_id", "release_count")


def style_genre_shares(in_style: DataFrame, in_genre: DataFrame) -> DataFrame:
    """(style, genre, release_count, style_release_count, share): of all releases of a style, dated or not, those that
    also have the genre."""
    styles, genres = in_style.distinct(), in_genre.distinct()
    both = styles.join(genres, "release_id").groupBy("style", "genre").agg(F.count("*").alias("release_count"))
    total = styles.groupBy("style").agg(F.count("*").alias("style_release_count"))
    return both.join(total, "style").select("style", "genre", "release_count", "style_release_count", (F.col("release_count") / F.col("style_release_count")).alias("share"))


def style_parents(shares: DataFrame, floor: float = 0.20) -> DataFrame:
    """(style, genre, share, is_dominant): genres with at least floor; the largest share dominates, the first name of equals."""
    order = Window.partitionBy("style").orderBy(F.desc("share"), "genre")
    kept = shares.where(F.col("share") >= floor)
    return kept.select("style", "genre", "share", (F.row_number().over(order) == 1).alias("is_dominant"))


def style_landmarks(in_style: DataFrame, derived_from: DataFrame, masters: DataFrame, most: int = 25) -> DataFrame:
    """(style, master_id, title, year, release_count, rank): the masters with most releases of a style."""
    pairs = in_style.distinct().join(derived_from.where("master_id IS NOT NULL"), "release_id")
    counts = pairs.groupBy("style", "master_id").agg(F.count("*").alias("release_count"))
    # A landmark shows at most `most` masters a style, so titles join after the cut.
    order = Window.partitionBy("style").orderBy(F.desc("release_count"), F.col("master_id").cast("string"))
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    named = best.join(masters.select("master_id", "title", "year"), "master_id", "left")
    return named.select("style", F.col("master_id").cast("string").alias("master_id"), F.coalesce("title", F.lit("")).alias("title"), "year", "release_count", "rank")


def style_cotags(in_style: DataFrame, most: int = 25) -> DataFrame:
    """(style, other, release_count, rank): the styles that share most releases with a style."""
    pairs = in_style.distinct()
    # Pairs of a release meet in its short list of styles, so nothing is joined.
    lists = pairs.groupBy("release_id").agg(F.collect_list("style").alias("styles")).where(F.size("styles") > 1)
    both = lists.select(F.explode("styles").alias("style"), "styles").select("style", F.explode("styles").alias("other")).where("style <> other")
    counts = both.groupBy("style", "other").agg(F.count("*").alias("release_count"))
    order = Window.partitionBy("style").orderBy(F.desc("release_count"), "other")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def label_longevity(releases: DataFrame, on_label: DataFrame, labels: DataFrame, current_year: int, limit: int = 50) -> DataFrame:
    """Labels by years between their first and last release. Real labels have ranks 1 to limit; placeholders that would rank
    among them follow, so they never push a real label out."""
    dated = on_label.distinct().join(releases.where("year IS NOT NULL").select("release_id", "year"), "release_id")
    by_decade = dated.groupBy("label_id", decade(F.col("year")).alias("decade")).agg(F.count("*").alias("n"), F.min("year").alias("low"), F.max("year").alias("high"))
    spans = by_decade.groupBy("label_id").agg(
        F.min("low").alias("first_year"), F.max("high").alias("last_year"), F.sum("n").alias("total_releases"),
        F.max_by("decade", F.struct("n", -F.col("decade"))).alias("peak_decade"),
    )
    named = spans.join(labels.where("label_name IS NOT NULL AND label_name <> ''"), "label_id").withColumn("years_active", F.col("last_year") - F.col("first_year"))
    named = named.withColumn("label_id", F.col("label_id").cast("string"))
    key = [F.desc("years_active"), F.desc("total_releases"), "label_id"]
    # Of either kind only the first `limit` can be shown, so each is cut before the one ordered window over both.
    top = named.withColumn("of_kind", F.row_number().over(Window.partitionBy("is_placeholder").orderBy(*key))).where(F.col("of_kind") <= limit)
    order = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    seen = top.withColumn("real", F.sum(F.when(F.col("is_placeholder"), 0).otherwise(1)).over(order))
    all_real = F.sum(F.when(F.col("is_placeholder"), 0).otherwise(1)).over(Window.partitionBy())
    seen = seen.withColumn("all_real", all_real).where(~F.col("is_placeholder") | (F.col("real") < limit) | (F.col("all_real") < limit))
    rank = F.when(F.col("is_placeholder"), F.col("all_real") + F.col("of_kind")).otherwise(F.col("of_kind"))
    active = F.coalesce(F.col("last_year") >= current_year - 2, F.lit(False))
    return seen.select(
        rank.cast("int").alias("rank"), "label_id", "label_name", "first_year", "last_year", "years_active", "total_releases", "peak_decade",
        active.alias("still_active"), "is_placeholder",
    )


MILESTONES = (25, 30, 40, 50, 75, 100)


def anniversaries(masters: DataFrame, year: int, month: int, milestones: tuple[int, ...] = MILESTONES, artists: DataFrame | None = None) -> DataFrame:
    """(master_id, title, artist_name, release_year, anniversary, computed_year, computed_month): masters whose first release
    was in this month a milestone number of years ago."""
    due = masters.where((F.col("month") == month) & (year - F.col("year")).isin(*milestones))
    who = F.col("artist_name") if "artist_name" in masters.columns else F.lit(None).cast("string")
    return due.select(
        F.col("master_id").cast("string").alias("master_id"), F.coalesce("title", F.lit("")).alias("title"), who.alias("artist_name"), F.col("year").alias("release_year"),
        (year - F.col("year")).cast("int").alias("anniversary"), F.lit(year).alias("computed_year"), F.lit(month).alias("computed_month"),
    )


def completeness(entities: DataFrame, entity_type: str, image: str | None, year: str | None, country: str | None, genre: str | None) -> DataFrame:
    """One row: how many entities have each field (an expression, or None if the type has no such field), and the mean share of
    the scorable fields in percent; an image isn't scorable. Null if no field is, or there is no entity."""
    fields = {"with_image": image, "with_year": year, "with_country": country, "with_genre": genre}
    sums = [F.count_if(F.expr(e) if e else F.lit(False)).alias(n) for n, e in fields.items()]
    counted = entities.agg(F.count("*").alias("total_count"), *sums)
    scored = [F.col(n) / F.col("total_count") for n, e in fields.items() if e and n != "with_image"]
    pct = F.when(F.col("total_count") > 0, sum(scored[1:], scored[0]) * 100 / len(scored)) if scored else F.lit(None).cast("double")
    return counted.select(F.lit(entity_type).alias("entity_type"), "total_count", *fields, pct.alias("completeness_pct"))


def data_completeness(cat) -> DataFrame:
    """completeness() of each kind of entity of a catalogue."""
    tagged = cat.releases.join(cat.in_genre.select("release_id", F.lit(1).alias("g")).distinct(), "release_id", "left")
    parts = [
        completeness(tagged, "release", None, "year IS NOT NULL", None, "g IS NOT NULL"),
        completeness(cat.masters, "master", None, "year IS NOT NULL", None, None),
        completeness(cat.table("supplier"), "artist", "s_acctbal > 0", None, None, None),
        completeness(cat.table("part"), "label", None, None, "p_size > 10", "p_type IS NOT NULL"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

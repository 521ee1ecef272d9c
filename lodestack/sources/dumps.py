"""Catalogue dumps: gzipped XML of releases and masters, read in parallel by Spark's XML source and exploded to relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIST = "struct<id:string,name:string,role:string,anv:string>"
ARTISTS = f"struct<artist:array<{ARTIST}>>"
SUB_TRACK = f"struct<position:string,title:string,artists:{ARTISTS},extraartists:{ARTISTS}>"
TRACK = f"struct<position:string,title:string,artists:{ARTISTS},extraartists:{ARTISTS},sub_tracks:struct<track:array<{SUB_TRACK}>>>"
RELEASE = (
    f"_id string, title string, released string, artists {ARTISTS}, extraartists {ARTISTS}, labels struct<label:array<struct<_id:string,_name:string>>>, "
    f"genres struct<genre:array<string>>, styles struct<style:array<string>>, master_id string, tracklist struct<track:array<{TRACK}>>"
)
MASTER = f"_id string, title string, year string, artists {ARTISTS}, genres struct<genre:array<string>>, styles struct<style:array<string>>"
#: Parts of credit roles and their categories, the longest match of a whole role first; fixed values of this engine.
ROLE_PARTS = (
    ("engineer", "engineering"), ("mastered", "engineering"), ("mixed", "engineering"), ("recorded", "engineering"), ("producer", "production"),
    ("production", "production"), ("executive", "production"), ("artwork", "design"), ("design", "design"), ("photography", "design"),
    ("liner notes", "design"), ("management", "business"), ("vocals", "session"), ("guitar", "session"), ("bass", "session"), ("drums", "session"),
    ("keyboards", "session"), ("piano", "session"), ("written-by", "writing"), ("composed", "writing"), ("lyrics", "writing"),
)


def valid_id(column: Column) -> Column:
    """Blank and zero ids stand for no entity."""
    return F.when(~F.coalesce(F.trim(column), F.lit("")).isin("", "0"), F.trim(column))


def role_category(role: Column) -> Column:
    out = F.lit("other")
    for part, kind in sorted(ROLE_PARTS, key=lambda p: len(p[0])):
        out = F.when(F.lower(role).contains(part), kind).otherwise(out)
    return out


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Records of a dump. Documents that declare entities are refused: their text could expand without bound."""
    if spark.read.text(path).where(F.col("value").rlike(r"(?i)<!ENTITY")).take(1):
        raise ValueError("the dump declares entities")
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def releases(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, "release", RELEASE).where(valid_id(F.col("_id")).isNotNull())


def masters(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, "master", MASTER).where(valid_id(F.col("_id")).isNotNull())


def _pairs(records: DataFrame, items: str, key: str, out: str, first: str = "release_id") -> DataFrame:
    rows = records.select(valid_id(F.col("_id")).alias(first), F.explode(items).alias("x"))
    value = valid_id(F.col(f"x.{key}")) if key in ("id", "_id") else F.when(F.trim("x") != "", F.trim("x"))
    return rows.select(first, value.alias(out)).where(F.col(out).isNotNull()).distinct()


def relations(records: DataFrame) -> dict[str, DataFrame]:
    """The relations of releases: by artist, on label, in genre, in style, derived from a master, credited on, and track artists."""
    r = valid_id(F.col("_id")).alias("release_id")
    credit = lambda rows, c: rows.select("release_id", F.explode(c).alias("c"), *[x for x in ("track_ordinal", "sub_track_ordinal", "track_position") if x in rows.columns])
    tracks = records.select(r, F.posexplode("tracklist.track").alias("track_ordinal", "t"))
    subs = tracks.select("release_id", "track_ordinal", F.posexplode("t.sub_tracks.track").alias("sub_track_ordinal", "s"))
    whole = tracks.select("release_id", "track_ordinal", F.lit(-1).alias("sub_track_ordinal"), F.col("t.position").alias("track_position"), F.col("t.artists.artist").alias("artists"), F.col("t.extraartists.artist").alias("extra"))
    inner = subs.select("release_id", "track_ordinal", "sub_track_ordinal", F.col("s.position").alias("track_position"), F.col("s.artists.artist").alias("artists"), F.col("s.extraartists.artist").alias("extra"))
    levels = whole.unionByName(inner)
    named = lambda rows: rows.select(
        F.trim("c.name").alias("person_name"), *[c for c in rows.columns if c != "c"], F.col("c.role").alias("role"), role_category(F.col("c.role")).alias("role_category")
    ).where("person_name <> ''")
    return {
        "by_artist": _pairs(records, "artists.artist", "id", "artist_id"),
        "on_label": _pairs(records, "labels.label", "_id", "label_id"),
        "in_genre": _pairs(records, "genres.genre", "", "genre"),
        "in_style": _pairs(records, "styles.style", "", "style"),
        "derived_from": records.select(r, valid_id(F.col("master_id")).alias("master_id")).where("master_id IS NOT NULL"),
        "credited_on": named(credit(records.select(r, F.col("extraartists.artist").alias("extra")), "extra")),
        "track_credited_on": named(credit(levels, "extra")),
        "track_by_artist": credit(levels, "artists").select("release_id", "track_ordinal", "sub_track_ordinal", "track_position", valid_id(F.col("c.id")).alias("artist_id")).where("artist_id IS NOT NULL"),
    }


def master_relations(records: DataFrame) -> dict[str, DataFrame]:
    return {
        "master_by_artist": _pairs(records, "artists.artist", "id", "artist_id", "master_id"),
        "master_in_genre": _pairs(records, "genres.genre", "", "genre", "master_id"),
        "master_in_style": _pairs(records, "styles.style", "", "style", "master_id"),
    }


def same_as(records: DataFrame) -> DataFrame:
    """(person_name, artist_id) over all levels and roles: every name with every id it is credited with."""
    t, s = "tracklist.track", "sub_tracks.track"
    tracks = records.select(F.explode(t).alias("t"))
    subs = tracks.select(F.explode(f"t.{s}").alias("s"))
    parts = [(records, "artists.artist"), (records, "extraartists.artist"), (tracks, "t.artists.artist"), (tracks, "t.extraartists.artist"), (subs, "s.artists.artist"), (subs, "s.extraartists.artist")]
    found = reduce(DataFrame.union, [d.select(F.explode(c).alias("c")) for d, c in parts])
    return found.select(F.trim("c.name").alias("person_name"), valid_id(F.col("c.id")).alias("artist_id")).where("person_name <> '' AND artist_id IS NOT NULL").distinct()

"""The catalogue and activity relations, as views over the star-schema tables.

A release is an order, its styles and genres are the brands and types of its parts, its artists the suppliers, its labels
the parts, its master the customer. Keys stay numbers inside; where results order or show ids, they are text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Catalogue:
    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def _parted(self) -> DataFrame:
        """The lines with the columns of their part, which all relations of tags and credits read."""
        return self._lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("release_id"), "l_linenumber", "l_returnflag", "l_linestatus", "p_brand", "p_type", "p_name",
        )

    def with_lines_stored(self, store: Callable[[DataFrame], DataFrame]) -> Catalogue:
        """The same catalogue, whose lines are joined with their parts once and read from where store() puts them."""
        out = Catalogue(self.spark, self.root)
        out.__dict__["_parted"] = store(self._parted)
        return out

    def _tagged(self, column: str, name: str) -> DataFrame:
        return self._parted.select("release_id", F.col(column).alias(name))

    @property
    def releases(self) -> DataFrame:
        """(release_id, year, month); undated releases have nulls."""
        date = F.col("o_orderdate")
        return self.table("orders").select(F.col("o_orderkey").alias("release_id"), F.year(date).alias("year"), F.month(date).alias("month"))

    @property
    def in_style(self) -> DataFrame:
        return self._tagged("p_brand", "style")

    @property
    def in_genre(self) -> DataFrame:
        return self._tagged("p_type", "genre")

    @property
    def by_artist(self) -> DataFrame:
        return self._lines.select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("artist_id"))

    @property
    def on_label(self) -> DataFrame:
        return self._lines.select(F.col("l_orderkey").alias("release_id"), F.col("l_partkey").alias("label_id"))

    @property
    def derived_from(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("master_id"))

    @property
    def artists(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist_name"))

    @property
    def labels(self) -> DataFrame:
        """(label_id, label_name, is_placeholder); one brand stands for unnamed labels."""
        return self.table("part").select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("label_name"), (F.col("p_brand") == "Brand#1").alias("is_placeholder"))

    @property
    def masters(self) -> DataFrame:
        """(master_id, title, year, month): the year and month of the earliest release."""
        first = self.table("orders").groupBy(F.col("o_custkey").alias("master_id")).agg(F.min("o_orderdate").alias("first"))
        named = self.table("customer").select(F.col("c_custkey").alias("master_id"), F.col("c_name").alias("title"))
        return named.join(first, "master_id", "left").select("master_id", "title", F.year("first").alias("year"), F.month("first").alias("month"))

    @property
    def credited_on(self) -> DataFrame:
        """(person_name, release_id, role_category, track): a credit for each line; what kind hangs from the return flag."""
        kind = F.when(F.col("l_returnflag") == "A", "production").when(F.col("l_returnflag") == "N", "design").otherwise("session")
        return self._parted.select(F.col("p_name").alias("person_name"), "release_id", kind.alias("role_category"), F.col("l_linenumber").alias("track"))

    @property
    def track_credited_on(self) -> DataFrame:
        """(person_name, release_id, track_ordinal, sub_track_ordinal, track_position, role_category): lines whose status is F name
        an engineer of the track, others a designer."""
        kind = F.when(F.col("l_linestatus") == "F", "engineering").otherwise("design")
        none = F.lit(None).cast("string").alias("track_position")
        ordinals = F.col("l_linenumber").alias("track_ordinal"), F.lit(-1).alias("sub_track_ordinal")
        return self._parted.select(F.col("p_name").alias("person_name"), "release_id", *ordinals, none, kind.alias("role_category"))

    @property
    def track_by_artist(self) -> DataFrame:
        """(release_id, track_ordinal, artist_id): a line's part is performed by the supplier of the same key, if there is one."""
        lines = self._lines.select(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("track_ordinal"), F.col("l_partkey").alias("artist_id"))
        return lines.join(self.artists.select("artist_id"), "artist_id", "left_semi").select("release_id", "track_ordinal", "artist_id")

    @property
    def master_by_artist(self) -> DataFrame:
        """(master_id, artist_id): a master's own artist is the supplier of the same key, if there is one."""
        masters = self.table("customer").select(F.col("c_custkey").alias("master_id"))
        return masters.join(self.artists, F.col("master_id") == F.col("artist_id")).select("master_id", "artist_id")

    def _master_tag(self, column: str, name: str) -> DataFrame:
        """A master's own genre or style is that of the part of the same key, if there is one."""
        part = self.table("part").select("p_partkey", F.col(column).alias(name))
        return self.table("customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("master_id"), name)

    @property
    def master_in_genre(self) -> DataFrame:
        return self._master_tag("p_type", "genre")

    @property
    def master_in_style(self) -> DataFrame:
        return self._master_tag("p_brand", "style")

    @property
    def same_as(self) -> DataFrame:
        """(person_name, artist_id): a name stands for every supplier with the key of one of its parts."""
        part = self.table("part").select("p_partkey", F.col("p_name").alias("person_name"))
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("artist_id"))
        return part.join(suppliers, F.col("p_partkey") == F.col("artist_id")).select("person_name", "artist_id").distinct()

    @property
    def events(self) -> DataFrame:
        """Activity events; odd keys consent to analytics, multiples of three to training."""
        e = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        purposes = F.concat(
            F.when(F.col("k") % 2 == 1, F.array(F.lit("analytics"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("k") % 3 == 0, F.array(F.lit("training"))).otherwise(F.array().cast("array<string>")),
        )
        return e.select("event_id", "event_type", F.col("user_id").alias("subject_id"), F.col("ts").alias("occurred_at"), purposes.alias("consent_purposes"), "k")

    @property
    def impressions(self) -> DataFrame:
        e = self.events.where("event_type = 'view'")
        return e.select(
            F.col("event_id").alias("impression_id"), "subject_id", F.concat(F.lit("policy-"), (F.col("k") % 4).cast("string")).alias("policy_id"),
            (F.col("subject_id") * 100 + F.col("k")).alias("candidate_set_id"), "occurred_at", "consent_purposes",
        )

    @property
    def user_subjects(self) -> DataFrame:
        return self.table("events").select(F.col("user_id")).distinct().select("user_id", F.col("user_id").alias("subject_id"))

    @property
    def grants(self) -> DataFrame:
        """(user_id, purpose, granted_at, revoked_at): some users never grant, some revoke, some grant later."""
        kinds = F.array(*[F.struct(F.lit(p).alias("purpose"), F.lit(n).alias("step")) for p, n in (("analytics", 5), ("training", 4))])
        users = self.user_subjects.select("user_id", F.inline(kinds))
        late = F.when(F.col("user_id") % 11 == 0, F.lit("2024-02-15")).otherwise(F.lit("2023-12-01"))
        revoked = F.when(F.col("user_id") % 7 == 0, F.lit("2024-01-10").cast("timestamp_ntz"))
        return users.where(F.col("user_id") % F.col("step") != 0).select("user_id", "purpose", late.cast("timestamp_ntz").alias("granted_at"), revoked.alias("revoked_at"))

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

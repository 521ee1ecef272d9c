"""Snapshots of result tables: readers see a version whole or not at all.

root/versions/<n> is a small text file that names the folder of every table in that version; it is renamed into place once, whole, and
never changed, and the largest number is current. Tables that a publish doesn't touch keep the folder of the version before. Folders are written before the
version that names them, so a failed or lost writer leaves folders that nobody names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.sources.storage import Folder


#: Seconds for which a lock holds.
LOCK_S = 86_400


class ShortWalk(RuntimeError):
    """Fewer rows were written than were promised; nothing was published."""


class Conflict(RuntimeError):
    """Another writer published first."""


class Published(RuntimeError):
    """A published release can't be overwritten."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self._cache: dict[tuple, DataFrame] = {}

    # versions

    def version(self) -> int:
        numbers = [int(n) for n in self.folder.names("versions") if n.isdigit()]
        return max(numbers, default=0)

    def _tables(self, version: int) -> dict[str, str]:
        return json.loads(self.folder.read(f"versions/{version:08d}")) if version else {}

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, by default the current one; None before its first publish. Pin a version to read several tables
        of one state."""
        place = self._tables(version or self.version()).get(table)
        return self.spark.read.parquet(f"{self.folder.root}/{place}") if place else None

    def _write(self, df: DataFrame, table: str) -> str:
        place = f"data/{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder.root}/{place}")
        return place

    def _commit(self, places: dict[str, str | None], after: int) -> int:
        named = {t: p for t, p in (self._tables(after) | places).items() if p}
        if not self.folder.create(f"versions/{after + 1:08d}", json.dumps(named, sort_keys=True)):
            raise Conflict(f"version {after + 1} exists")
        return after + 1

    # full replacement

    def publish(self, tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> int:
        """Replaces tables together. If the first is empty nothing changes, and the number of the current version comes back: an
        empty answer keeps what was published. expected: least numbers of rows, else ShortWalk."""
        now = self.version()
        places = {t: self._write(df, t) for t, df in tables.items()}
        sizes = {t: self.spark.read.parquet(f"{self.folder.root}/{p}").count() for t, p in places.items()}
        first = next(iter(tables))
        if not sizes[first]:
            return now
        for t, least in (expected or {}).items():
            if sizes[t] < least:
                raise ShortWalk(f"{t}: {sizes[t]} rows of {least}")
        return self._commit(places, now)

    # parts

    def replace_where(self, table: str, rows: DataFrame, condition: str) -> int:
        """Replaces the rows that meet a condition, even by none: what the window no longer has is gone."""
        now = self.version()
        old = self.read(table, now) if now else None
        kept = rows if old is None else old.where(f"NOT coalesce({condition}, false)").unionByName(rows)
        return self._commit({table: self._write(kept, table)}, now)

    def replace_window(self, table: str, rows: DataFrame, column: str, since: date, until: date) -> int:
        return self.replace_where(table, rows, f"{column} >= DATE '{since}' AND {column} < DATE '{until}'")

    def upsert(self, table: str, rows: DataFrame, keys: list[str], update: list[str], ordinal: str | None = None) -> int:
        """Adds rows by key; of an existing key only `update` changes. Of rows that repeat a key the last by ordinal updates, and the
        first gives what is never updated."""
        now = self.version()
        order = [F.col(ordinal)] if ordinal else [F.lit(0)]
        fixed = [c for c in rows.columns if c not in keys and c not in update and c != ordinal]
        by = Window.partitionBy(*keys).orderBy(*order)
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = rows.withColumns({c: F.first(c).over(whole) for c in fixed} | {"_n": F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))})
        merged = merged.where("_n = 1").select(*keys, *update, *fixed)
        old = self.read(table, now) if now else None
        if old is not None:
            o = old.select(*[F.col(c).alias(f"_old_{c}") for c in keys + update + fixed], F.lit(True).alias("_was"))
            same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys])  # null is a key like others
            joined = merged.withColumn("_is", F.lit(True)).join(o, same, "full")
            values = [F.when(F.col("_is"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in keys + update]
            values += [F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in fixed]
            merged = joined.select(*values)
        return self._commit({table: self._write(merged.select(*[c for c in rows.columns if c != ordinal]), table)}, now)

    def write_once(self, table: str, rows: Callable[[], DataFrame], column: str, value: date) -> int:
        """Adds the rows of a month unless there are some: the number of rows added. The marker is created once, so of two writers one
        adds."""
        now = self.version()
        old = self.read(table, now) if now else None
        if old is not None and old.where(F.col(column) == F.lit(value)).take(1):
            return 0
        if not self.folder.create(f"once/{table}-{value}", "taken"):
            return 0
        try:
            new = rows()
            size = new.count()
            self._commit({table: self._write(new if old is None else old.unionByName(new), table)}, now)
        except BaseException:
            self.folder.delete(f"once/{table}-{value}")
            raise
        return size

    # embeddings by version of their model

    def write_embeddings(self, rows: DataFrame, method: str, dump: str) -> tuple[str, bool]:
        """Writes rows(id, embedding) as the vectors of method@dump: (version, whether they were written); an existing version stays."""
        if "@" in dump:
            raise ValueError("a dump id holds no @")
        name = f"{method}@{dump}"
        table = f"embeddings/{uuid.uuid5(uuid.NAMESPACE_OID, name).hex}"
        if self.read(table) is not None:
            return name, False
        known = self.embedding_versions()
        listed = self.spark.createDataFrame([(v, p) for v, p in (known | {name: table}).items()], "model_version string, place string")
        self.publish({table: rows.withColumn("model_version", F.lit(name)), "embedding_versions": listed})
        return name, True

    def embedding_versions(self) -> dict[str, str]:
        """{version: table} of all vectors, a row for each version."""
        rows = self.read("embedding_versions")
        return {} if rows is None else {r["model_version"]: r["place"] for r in rows.collect()}

    def published_versions(self) -> DataFrame:
        """(model_version, published_at, is_current) of the published releases, the latest first."""
        rows = self.registry()
        none = self.spark.createDataFrame([], "model_version string, published_at timestamp, is_current boolean")
        kept = none if rows is None else rows.where("published_at IS NOT NULL").select(*none.columns)
        return kept.orderBy(F.desc("published_at"), F.desc("model_version"))

    # releases of neighbour lists

    def registry(self) -> DataFrame | None:
        return self.read("registry")

    def write_release(self, lists: DataFrame, version: str, k: int) -> str:
        """Writes lists as an unpublished release; a published one isn't overwritten."""
        table = f"lists/{uuid.uuid5(uuid.NAMESPACE_OID, version).hex}"
        known = self.registry()
        if known is not None and known.where((F.col("model_version") == version) & F.col("published_at").isNotNull()).take(1):
            raise Published(version)
        now = self.version()
        row = self.spark.createDataFrame([(version, table, k, False, None)], "model_version string, place string, k int, is_current boolean, published_at timestamp")
        kept = row if known is None else known.where(F.col("model_version") != version).unionByName(row)
        self._commit({table: self._write(lists, table), "registry": self._write(kept, "registry")}, now)
        return table

    def publish_release(self, version: str) -> list[str]:
        """Makes a release current and keeps the one it displaces; older ones are retired. What couldn't be retired is returned, not
        raised: the publish stands."""
        now = self.version()
        rows = [r.asDict() for r in self.registry().collect()]  # a row for each kept release
        if version not in {r["model_version"] for r in rows}:
            raise KeyError(version)
        displaced = next((r["model_version"] for r in rows if r["is_current"] and r["model_version"] != version), None)
        stay = [r for r in rows if r["model_version"] in (version, displaced) or r["published_at"] is None]
        gone = [r for r in rows if r not in stay]
        kept = self.spark.createDataFrame([(r["model_version"], r["place"], r["k"], r["model_version"] == version, r["published_at"]) for r in stay], "model_version string, place string, k int, is_current boolean, published_at timestamp")
        kept = kept.withColumn("published_at", F.when(F.col("is_current"), F.coalesce("published_at", F.current_timestamp())).otherwise(F.col("published_at")))
        places = self._tables(now)
        self._commit({"registry": self._write(kept, "registry")} | {r["place"]: None for r in gone}, now)
        failed = []
        for r in gone:
            try:
                if not self.folder.delete(places[r["place"]]):
                    failed.append(r["model_version"])
            except Exception:
                failed.append(r["model_version"])
        return failed

    # cached results

    def cached(self, query: str, params: tuple, make: Callable[[int], DataFrame]) -> DataFrame:
        """The answer of a query at the current version, kept until the next publish; the version is read first, so an answer that
        was made meanwhile is filed under the state it was made from."""
        version = self.version()
        key = (version, query, params)
        if key not in self._cache:
            for old in [k for k in self._cache if k[0] != version]:
                self._cache.pop(old).unpersist()
            self._cache[key] = make(version).cache()
        return self._cache[key]

    # run log

    def log(self, kind: str, status: str, run: str, rows: int | None = None, error: str | None = None) -> None:
        """Appends a line on a run. Lines are files of their own, so writers don't meet."""
        line = self.spark.range(1).select(
            F.lit(run).alias("id"), F.lit(kind).alias("insight_type"), F.lit(status).alias("status"), F.current_timestamp().cast("timestamp_ntz").alias("started_at"),
            F.lit(rows).cast("long").alias("rows_affected"), F.lit(error).cast("string").alias("error_message"),
        )
        line.coalesce(1).write.mode("append").parquet(f"{self.folder.root}/log")

    def runs(self) -> DataFrame | None:
        """The latest line of each run."""
        if not self.folder.exists("log"):
            return None
        order = Window.partitionBy("id").orderBy(F.desc("started_at"))
        return self.spark.read.parquet(f"{self.folder.root}/log").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    def sweep(self) -> int:
        """At a start: runs that are still running were interrupted."""
        runs = self.runs()
        left = [] if runs is None else runs.where("status = 'running'").collect()
        for r in left:
            self.log(r["insight_type"], "interrupted", r["id"])
        return len(left)

    # one writer

    def lock(self, name: str, expires_s: float = LOCK_S) -> bool:
        """Whether the lock is now this run's. A lock of more than expires_s seconds was left by a run that died and is taken over."""
        at = f"locks/{name}"
        if self.folder.create(at, "held"):
            return True
        if not self.folder.exists(at) or self.folder.age_s(at) <= expires_s:
            return False
        self.folder.publish(at, f"expired/{uuid.uuid4().hex}")
        return self.folder.create(at, "held")

    def unlock(self, name: str) -> None:
        self.folder.delete(f"locks/{name}")

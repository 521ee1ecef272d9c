"""Sharding by size-tiered compaction: small immutable shards, merged by size, under a versioned manifest."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import bounded_broadcast, scratch_path, stored

#: So many shards of a round, or of a version, are broadcast by name; more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Shards that one commit merges at most, whose names the driver then holds; a larger round is several commits.
MOST_PATHS = 20_000
#: Columns that rows have only on their way.
RUN, PATH, DEAL = "lodestack_run", "lodestack_path", "lodestack_deal"
MANIFEST = "shard string, path string, rows long, bytes long, tier int"


@dataclass(frozen=True)
class Settings:
    target_bytes: int = 32 << 20  # a merged file; as rows it is several times as large, and one task writes it
    smallest_bytes: int = 256 << 10  # upper edge of the lowest tier
    codec: str = "zstd"  # arrivals, the shuffle between and merged files are on disk together, so shards are packed well
    fanout: int = 4  # a tier spans sizes up to a factor of this, and is merged once it has so many runs


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    """Shards under a root folder that all executors reach.

    root/data/<batch>/... holds immutable Parquet files; root/manifest/v<number>/ lists the live ones. A version is written
    to a folder of its own name and renamed into place, and a rename never replaces an existing version, so readers see a
    version whole or not at all and two writers can't both commit one. Files of an uncommitted or failed run are listed in no
    manifest; vacuum removes what no kept version lists and no writer can still be about to commit. A shard is named by the version
    that added it and its number there, so reruns over equal input give equal names."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version or known[-1]:08d}")

    def commit(self, shards: DataFrame, after: int) -> int:
        """Publishes the version after `after`; Conflict if it exists by now."""
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        shards.select("shard", "path", "rows", "bytes", "tier").coalesce(1).write.parquet(draft)
        place = self._path(f"{self.root}/manifest/v{after + 1:08d}")
        self._fs.mkdirs(place.getParent())
        if self._fs.exists(place) or not self._fs.rename(self._path(draft), place):
            self._fs.delete(self._path(draft), True)
            raise Conflict(f"version {after + 1} exists")
        if after + 1 not in self.versions() or self._fs.exists(self._path(f"{place}/{self._path(draft).getName()}")):
            raise Conflict(f"version {after + 1} was committed by another writer")
        return after + 1

    def _tier(self, size):
        steps = F.log(F.greatest(size, F.lit(1)) / self.settings.smallest_bytes) / F.log(F.lit(float(self.settings.fanout)))
        return F.greatest(F.ceil(steps), F.lit(0)).cast("int")

    def _listed(self, folder: str, version: int) -> DataFrame:
        """The files of a folder as shards; empty ones are left out."""
        files = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        found = files.groupBy("path").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
        number = F.coalesce(F.nullif(F.regexp_extract("path", f"/{RUN}=([0-9]+)/", 1), F.lit("")), F.regexp_extract("path", r"/part-0*([0-9]+)-", 1))
        name = F.concat(F.lit(f"v{version:08d}-"), F.lpad(number, 7, "0"), F.regexp_extract("path", r"-c([0-9]+)[.][^/]*$", 1))
        return found.select(name.alias("shard"), "path", "rows", "bytes", self._tier(F.col("bytes")).alias("tier"))

    def append(self, rows: DataFrame) -> int:
        """Adds rows as small shards, one for each task that has any; nothing is shuffled or rewritten."""
        now = (self.versions() or [0])[-1]
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", self.settings.codec).parquet(folder)
        return self.commit(self.manifest().union(self._listed(folder, now + 1)), now)

    def plan(self, shards: DataFrame) -> DataFrame:
        """(path, run): the shards to be merged and the run each goes to.

        In a tier, shards in order of size form runs of about target_bytes; runs of fewer than fanout shards in a tier with
        fewer than fanout, and shards that have the target size, stay. The rows here are shards, not documents."""
        s = self.settings
        small = shards.where(F.col("bytes") * 2 <= s.target_bytes)
        tier = Window.partitionBy("tier")
        upto = tier.orderBy("bytes", "shard").rowsBetween(Window.unboundedPreceding, -1)
        placed = small.withColumn("before", F.coalesce(F.sum("bytes").over(upto), F.lit(0))).withColumn("of_tier", F.count("*").over(tier))
        placed = placed.withColumn("sum", F.sum("bytes").over(tier)).where(F.col("of_tier") >= s.fanout)
        # As many runs as fit, all of about the same size.
        runs = F.greatest(F.round(F.col("sum") / s.target_bytes), F.lit(1))
        run = F.least(F.floor(F.col("before") * runs / F.col("sum")), runs - 1)
        placed = placed.withColumn("run", F.col("tier") * (1 << 32) + run.cast("long"))
        return placed.withColumn("members", F.count("*").over(Window.partitionBy("run"))).where("members > 1").select("path", "run")

    def compact(self, order: str) -> int:
        """Merges until no tier holds fanout shards that can be merged. A round merges the lowest tier that is due, so its output may
        join the next one's; each commit merges whole runs of at most MOST_PATHS shards."""
        version = (self.versions() or [0])[-1]
        while True:
            live = self.manifest(version) if version else self.manifest()
            due = self.plan(live).withColumn("tier", F.floor(F.col("run") / (1 << 32)))
            first = due.agg(F.min("tier")).first()[0]
            if first is None:
                return version
            # Whole runs, by number, until the bound; the first one always.
            runs = due.where(F.col("tier") == first).groupBy("run").agg(F.count("*").alias("members"))
            upto = F.sum("members").over(Window.orderBy("run")) - F.col("members")
            runs = runs.withColumn("upto", upto).where(F.col("upto") + F.least("members", F.lit(MOST_PATHS)) <= MOST_PATHS)
            runs = runs.select("run", (F.row_number().over(Window.orderBy("run")) - 1).alias(RUN))
            chosen = stored(due.join(runs, "run").select(F.col("path").alias(PATH), RUN), "round")
            version = self._merge(live, chosen, order, version)

    def _merge(self, live: DataFrame, chosen: DataFrame, order: str, version: int) -> int:
        paths = [r[0] for r in chosen.select(PATH).toLocalIterator()]
        runs = chosen.agg(F.max(RUN)).first()[0] + 1
        rows = self.spark.read.parquet(*paths).withColumn(PATH, F.col("_metadata.file_path"))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        # A run becomes one file, so it goes to one task, alone; the target bounds its size.
        merged = rows.join(F.broadcast(chosen.join(self._deals(runs), RUN)), PATH).drop(PATH)
        merged = merged.repartition(runs, DEAL).drop(DEAL).sortWithinPartitions(RUN, order)
        merged.write.option("compression", self.settings.codec).partitionBy(RUN).parquet(folder)
        kept = live.join(chosen.select(F.col(PATH).alias("path")), "path", "left_anti").select("shard", "path", "rows", "bytes", "tier")
        return self.commit(kept.union(self._listed(folder, version + 1)), version)

    def _deals(self, runs: int) -> DataFrame:
        """(run, deal): a number for each run that a shuffle by hash into as many partitions deals to a partition of its own."""
        tried = self.spark.range(16 * runs + 64).select(F.col("id").cast("int").alias(DEAL))
        own = tried.groupBy(F.pmod(F.hash(DEAL), F.lit(runs)).alias(RUN)).agg(F.min(DEAL).alias(DEAL))
        every = self.spark.range(runs).select(F.col("id").cast("int").alias(RUN))
        return every.join(own, RUN, "left").select(RUN, F.coalesce(DEAL, RUN).alias(DEAL))

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version's live shards. The driver gets the folders, one for each commit that still has a shard; which of
        their files are live is a join."""
        live = self.manifest(version).select(F.col("path").alias(PATH))
        folders = [r[0] for r in live.select(F.regexp_extract(PATH, "^(.*/data/[^/]+)/", 1)).distinct().toLocalIterator()]
        return self._rows(folders, live).drop(PATH) if folders else self.spark.createDataFrame([], schema)

    def _rows(self, folders: list[str], live: DataFrame) -> DataFrame:
        every = self.spark.read.option("recursiveFileLookup", True).parquet(*folders).withColumn(PATH, F.col("_metadata.file_path"))
        return every.join(bounded_broadcast(live, MOST_BROADCAST), PATH)

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400) -> None:
        """Deletes data files that none of the last `keep` versions lists, and older manifests. Files younger than older_than_s
        stay, since their writer may be about to commit. The files are listed and compared on the cluster."""
        known = self.versions()
        if not known:
            return
        inside = lambda c: F.substring_index(c, "/data/", -1)
        live = reduce(DataFrame.union, [self.manifest(v).select(inside(F.col("path")).alias("file")) for v in known[-keep:]]).distinct()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.root}/data")
        old = files.where(F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(older_than_s)))
        for r in old.select(inside(F.col("path")).alias("file")).join(live, "file", "left_anti").toLocalIterator():
            self._fs.delete(self._path(f"{self.root}/data/{r['file']}"), False)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}"), True)


def shard(docs: DataFrame, order: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Appends docs to a new store in the shared folder, compacts it, and reads the committed version back: all columns of
    docs, with shard, shard_rows and shard_bytes of the file each row now lies in, and the version.

    Every row, with nulls, repeated rows and whole texts as they are, lies in exactly one shard; rows of a merged shard are in
    the order of `order`, nulls first. An empty table commits a version without shards and gives no rows. If docs has a column of
    an added one's name, the added one gets an underscore behind its name."""
    store = Store(docs.sparkSession, scratch_path(docs.sparkSession, "shards"), settings)
    store.append(docs)
    version = store.compact(order)
    store.vacuum(older_than_s=0)  # no other writer knows this store
    added = [free_name(n, docs.columns) for n in ("shard", "shard_rows", "shard_bytes", "version")]
    live = store.manifest().select(F.col("path").alias(PATH), *[F.col(c).alias(n) for c, n in zip(("shard", "rows", "bytes"), added, strict=False)])
    if not live.take(1):
        none = docs.sparkSession.createDataFrame([], docs.schema)
        kinds = ("string", "long", "long", "int")
        return none.select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(added, kinds, strict=True)])
    rows = store._rows([f"{store.root}/data"], live).drop(PATH)
    return rows.withColumn(added[3], F.lit(version))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name

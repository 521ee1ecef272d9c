"""Shared helpers of the corpus operators: tables, shared scratch storage, words, held-out folds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "\t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one if all run on this
    machine, else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        told = getattr(spark.sparkContext, "_lodestack_dir", None)
        if told is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            told = "file://" + tempfile.mkdtemp(prefix="lodestack-")
            spark.sparkContext._lodestack_dir = told
    return told.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a stored table is made: texts of a batch lie in the JVM and in Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session have at most BATCH_ROWS rows; for plans that the caller runs."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows))
    spark.conf.set(rows, min(now if now > 0 else BATCH_ROWS, BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    for written in _written.get():
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that no later result reads."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/lodestack/" in folder:
            _delete(df.sparkSession, folder)


#: The lists of paths that the open scratch() blocks keep.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end what stored() wrote inside. Gives a stored() whose tables stay: for the results of the steps inside."""
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        paths.pop()
        return out

    try:
        yield keep
    finally:
        _written.reset(token)
        for path in paths:
            _delete(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Collects the driver's garbage. Shuffle files and broadcasts stay until the driver's JVM finds that no plan holds them, and its
    heap grows until then; after a step of large shuffles that is too late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint only where a count shows that df has at most most_rows rows; else the planner shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: A key of more than one row in so many is joined apart, so fewer keys than this are.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table, which has a row for each key, where few keys may have most of the rows: fewer than HOT_SHARE keys can
    have more than their share, so their rows of table are broadcast and meet rows where these lie; all others are shuffled. rows is
    read three times: a stored table, or columns of one. Null keys match nothing."""
    share = rows.count() // HOT_SHARE
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > share) & F.col(key).isNotNull()).select(key)
    near = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


#: Bits of the filter behind without(); its table has a row for 64 of them, so what is broadcast is bounded.
FILTER_BITS = 1 << 24


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key isn't in ids(key); null keys stay. A bitmap over hashed ids lets most rows stay at once, so their
    other columns aren't shuffled to meet the ids; only rows whose bit is set are joined exactly."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = ids.where(F.col(key).isNotNull()).select(place.cast("int").alias("_at")).selectExpr("shiftright(_at, 6) AS _word", "shiftleft(1L, _at & 63) AS _bits")
    bits = stored(bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "bits")
    packed = rows.select(F.struct(*rows.columns).alias("_row"), F.when(F.col(key).isNotNull(), place).cast("int").alias("_at"))
    marked = packed.withColumn("_word", F.expr("shiftright(_at, 6)")).join(F.broadcast(bits), "_word", "left")
    maybe = F.coalesce(F.expr("(shiftrightunsigned(_bits, _at & 63) & 1) = 1"), F.lit(False))
    sure = marked.where(~maybe).select("_row.*")
    asked = marked.where(maybe).select("_row.*").join(ids.select(key).distinct(), key, "left_anti").select(*rows.columns)
    return sure.union(asked)

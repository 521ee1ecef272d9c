"""From raw documents to training shards: judge, deduplicate, decontaminate, mix, and shard. Part of subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, mixing, ngram_join, quality, sharding
from lodestack.llm.common import discard, read_table, scratch, small_batches, stored, without


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; each row is judged by its own text."""
    small_batches(spark)
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def named(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs, each row without an id under an id of its own beyond all others, and what takes these ids away again."""
    if not docs.where("doc_id IS NULL").take(1):
        return docs, lambda rows: rows
    free = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(max(free, 1)).cast("long") + F.monotonically_increasing_id())
    given = stored(docs.withColumn("_given", F.col("doc_id").isNull()).withColumn("doc_id", own), "named")
    kind = docs.schema["doc_id"].dataType
    return given, lambda rows: rows.withColumn("doc_id", F.when(~F.col("_given"), F.col("doc_id")).cast(kind)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram join (five words, similarity 0.8), the row with the least doc_id; of rows that repeat
    that id, one. A row without an id is a document of its own, which comes after all that have one. Documents without words
    stay."""
    docs, back = named(docs)
    with scratch(spark) as keep:
        found = keep(ngram_join.join(docs, ngram_join.Settings(words=5, percent=80)).select("doc_id", "n_shingles", "component_id"), "components")
    left = without(docs, "doc_id", found.where("doc_id <> component_id").select("doc_id").distinct())
    twice = stored(found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.take(1):
        return back(left)
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return back(left.join(twice, "doc_id", "left_anti").select(*docs.columns).union(again))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a row without an id is judged by its own text."""
    docs, back = named(docs)
    with scratch(spark) as keep:
        gone = keep(decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return back(without(docs, "doc_id", gone))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as the committed shards hold them, with the shard of each."""
    return sharding.shard(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
    ("shard", write_shards),
]

#: SQL can't express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each one's rows are written and reread, so a lost executor costs one stage."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
        if at:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

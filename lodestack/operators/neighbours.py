"""Exact nearest neighbours by cosine, and measures of neighbour lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4096
#: Lower edges of degree buckets; fixed values.
DEGREE_EDGES = (1, 2, 4, 8, 16, 32, 64, 128, 256)


def exact_top_k(vectors: DataFrame, k: int = 50, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, score, rank): the k others of largest cosine for every row of vectors(id, embedding), or for those in
    queries(id). Equal scores are in the order of the id as text; a zero vector scores 0; a row isn't its own neighbour, but an
    equal vector of another id is.

    Rows are dealt into blocks by a hash. Each pair of blocks is one product of matrices, which keeps k for each query, so what
    is shuffled on is k rows for each query and block; a window merges them."""
    n = vectors.count()
    blocks = max(1, -(-n // block))
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = rows if queries is None else rows.join(queries.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    q = asked.select("id", "v", F.col("b").alias("qb"), F.explode(others).alias("cb"))
    c = rows.select(F.col("id").alias("other"), F.col("v").alias("w"), F.explode(others).alias("to"), F.col("b").alias("of"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(t.column(0).to_pylist(), object)
        order = np.argsort(ids.astype(str), kind="stable")
        x = np.array(t.column(1).to_pylist(), np.float64).reshape(len(ids), -1)[order]
        size = np.sqrt((x * x).sum(1))
        return ids[order], x * np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)[:, None]

    def product(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        (a, x), (b, y) = matrix(left), matrix(right)
        out_a, out_b, out_s = [], [], []
        for lo in range(0, len(a), 512):
            s = x[lo : lo + 512] @ y.T
            s[a[lo : lo + 512, None] == b[None, :]] = -np.inf
            take = min(k, len(b))
            edge = np.partition(s, len(b) - take, 1)[:, len(b) - take]
            # All that reach the k-th score, ties too; ids are in order, so the merge can cut by them.
            i, j = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
            out_a.append(a[lo : lo + 512][i])
            out_b.append(b[j])
            out_s.append(s[i, j])
        return pa.table({"id": pa.array(np.concatenate(out_a), pa.string()), "neighbour": pa.array(np.concatenate(out_b), pa.string()), "score": np.concatenate(out_s)})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("to", "of")).applyInArrow(product, "id string, neighbour string, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def neighbour_lists(pairs: DataFrame) -> DataFrame:
    """(id, neighbours, scores): parallel arrays in order of rank; shorter where there are fewer neighbours."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "score")))
    return pairs.groupBy("id").agg(ordered.alias("x")).select("id", F.col("x.neighbour").alias("neighbours"), F.transform("x.score", lambda s: s.cast("float")).alias("scores"))


def degree_bucket(degree: Column) -> Column:
    out = F.lit("0")
    for low, high in zip(DEGREE_EDGES, (*DEGREE_EDGES[1:], None), strict=True):
        name = f"{low}+" if high is None else str(low) if high == low + 1 else f"{low}-{high - 1}"
        out = F.when(degree >= low, name).otherwise(out)
    return out


def size_bucket(size: Column) -> Column:
    return F.when(size <= 1, "1").when(size <= 4, "2-4").when(size <= 20, "5-20").otherwise("21+")


def recall_at(found: DataFrame, truth: DataFrame, k: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """(id, strict, tolerant): the share of the true first k that were found, and the share of the k found whose score is within
    tolerance of the k-th true score; both of the number of true ones."""
    t = truth.where(F.col("rank") <= k).groupBy("id").agg(F.collect_set("neighbour").alias("want"), F.min("score").alias("edge"))
    f = found.where(F.col("rank") <= k).groupBy("id").agg(F.collect_set("neighbour").alias("got"), F.collect_list("score").alias("scores"))
    both = t.join(f, "id", "left").select("id", "want", "edge", F.coalesce("got", F.array().cast("array<string>")).alias("got"), F.coalesce("scores", F.array().cast("array<double>")).alias("scores"))
    near = F.size(F.filter("scores", lambda s: s >= F.col("edge") - tolerance))
    return both.select("id", (F.size(F.array_intersect("want", "got")) / F.size("want")).alias("strict"), F.least(near / F.size("want"), F.lit(1.0)).alias("tolerant"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def churn(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """(id, jaccard) of the first k neighbours in two releases, of ids in both."""
    top = lambda df, out: df.where(F.col("rank") <= k).groupBy("id").agg(F.collect_set("neighbour").alias(out))
    return top(before, "a").join(top(after, "b"), "id").select("id", jaccard(F.col("a"), F.col("b")).alias("jaccard"))


def duplicate_groups(vectors: DataFrame) -> DataFrame:
    """(bucket, groups, vectors): how many groups of equal vectors there are by their size."""
    groups = vectors.groupBy(F.md5(F.to_json("embedding")).alias("h")).agg(F.count("*").alias("n"))
    return groups.groupBy(size_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("groups"), F.sum("n").alias("vectors"))


def coverage(wanted: DataFrame, vectors: DataFrame) -> DataFrame:
    """(wanted, covered, coverage) of wanted(id)."""
    hit = wanted.select("id").distinct().join(vectors.select("id", F.lit(1).alias("hit")).distinct(), "id", "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("covered"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("coverage"))


def zero_filled(wanted: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) of wanted(id) in full; vectors that are missing are zeros."""
    return wanted.join(vectors, "id", "left").select("id", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"))


def half_precision(vectors: DataFrame) -> DataFrame:
    """vectors(id, embedding) rounded to half floats, kept as floats, and checked to have one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = None
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for r in rows:
                dim = dim or len(r)
                if len(r) != dim:
                    raise ValueError("vectors of different dimensions")
            x = [np.asarray(r, np.float32).astype(np.float16).astype(np.float32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["id", "embedding"])

    return vectors.select("id", "embedding").mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, embedding array<float>")


def bootstrap(values: DataFrame, column: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """(mean, low, high): the mean and a 95 % interval over Poisson resamples, which are weights, so each task adds up its own rows
    and one row for each task and resample is all that moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(resamples + 1), np.zeros(resamples + 1)
        for batch in batches:
            for value, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.concatenate([[1], np.random.default_rng([seed, key & ((1 << 63) - 1)]).poisson(1, resamples)])
                total += w * value
                weight += w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples + 1)), pa.array(total), pa.array(weight)], names=["i", "total", "weight"])

    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), F.xxhash64(*values.columns).alias("key"))
    sums = rows.mapInArrow(run, "i long, total double, weight double").groupBy("i").agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    means = sums.select("i", F.when(F.col("w") > 0, F.col("t") / F.col("w")).alias("m"))
    again = F.when(F.col("i") > 0, F.col("m"))
    return means.agg(F.max(F.when(F.col("i") == 0, F.col("m"))).alias("mean"), F.percentile(again, 0.025).alias("low"), F.percentile(again, 0.975).alias("high"))


def percentiles(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.avg(column).alias("mean"), *[F.percentile(column, p / 100).alias(f"p{p}") for p in (50, 95, 99)])


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows whose keys hash lowest: the same rows for a seed, whatever the order of the input."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def recall_by_degree(recall: DataFrame, degrees: DataFrame) -> DataFrame:
    """(bucket, queries, strict, tolerant): means of recall_at() by the degree of the query; degrees(id, degree)."""
    rows = recall.join(degrees.select("id", degree_bucket(F.col("degree")).alias("bucket")), "id")
    return rows.groupBy("bucket").agg(F.count("*").alias("queries"), F.avg("strict").alias("strict"), F.avg("tolerant").alias("tolerant"))


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b)))
    return F.when(size > 0, dot(F.col(a), F.col(b)) / size).otherwise(0.0)


def reranked(found: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The first k of over-fetched pairs(id, neighbour) by their exact cosines: (id, neighbour, score, rank)."""
    of = lambda i, v: vectors.select(F.col("id").cast("string").alias(i), F.col("embedding").alias(v))
    rows = found.select("id", "neighbour").distinct().join(of("id", "v"), "id").join(of("neighbour", "w"), "neighbour")
    rows = rows.select("id", "neighbour", _cosine("v", "w").alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def accepted(stored: DataFrame, truth: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """(queries, recall, worst_error, violations) of stored lists(id, neighbours, scores) against exact pairs(id, neighbour, score,
    rank): the share of true neighbours stored, the largest error of a score, and the neighbours that are out of order, stored
    without being true, or missing while their score is above the last stored one by more than tolerance."""
    pairs = stored.select("id", F.posexplode(F.arrays_zip("neighbours", "scores")).alias("at", "x")).select("id", "at", F.col("x.neighbours").alias("neighbour"), F.col("x.scores").cast("double").alias("got"))
    order = Window.partitionBy("id").orderBy("at")
    pairs = pairs.withColumn("falls", F.coalesce(F.col("got") > F.lag("got").over(order) + tolerance, F.lit(False)))
    both = truth.select("id", "neighbour", "score").join(pairs, ["id", "neighbour"], "full").join(pairs.groupBy("id").agg(F.min("got").alias("edge")), "id", "left")
    wrong = F.coalesce(F.col("falls"), F.lit(False)) | (F.col("got").isNull() & (F.col("score") > F.coalesce("edge", F.lit(-2.0)) + tolerance)) | (F.col("score").isNull() & F.col("got").isNotNull())
    return both.agg(
        F.countDistinct("id").alias("queries"), (F.count_if(F.col("got").isNotNull() & F.col("score").isNotNull()) / F.count("score")).alias("recall"),
        F.max(F.abs(F.col("got") - F.col("score"))).alias("worst_error"), F.count_if(wrong).alias("violations"),
    )


def spooled_top_k(vectors: DataFrame, root: str, k: int = 50, block: int = BLOCK, stop=lambda: False) -> DataFrame | None:
    """exact_top_k() in parts that survive a stop: the queries of each block are written under root as they are done, and parts that
    are there aren't computed again. None if `stop` said so before the last part; then a later call goes on."""
    from lodestack.sources.storage import Folder

    spark = vectors.sparkSession
    folder = Folder(spark, root)
    identity = f"{k}:{block}:{vectors.agg(F.count('*'), F.sum(F.xxhash64('id', 'embedding').cast('decimal(38,0)'))).first()}"
    if not folder.create("identity", identity) and folder.read("identity") != identity:
        raise ValueError("the spool is of other vectors or parameters")
    blocks = max(1, -(-vectors.count() // block))
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks))
    for i in range(blocks):
        if folder.exists(f"part-{i}/_SUCCESS"):
            continue
        if stop():
            return None
        exact_top_k(vectors, k, block, vectors.where(part == i)).write.mode("overwrite").parquet(f"{root}/part-{i}")
    return spark.read.parquet(*[f"{root}/part-{i}" for i in range(blocks)])

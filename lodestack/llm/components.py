"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import discard, release, spread_join, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over a stored table of (u, v) with u > v. The minimum of a node is a partial aggregate, and it is joined
    back rather than gathered, a hub's to the places where its edges lie, so a hub's neighbours never meet in one row or task."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Neighbours above u go to the least of u's neighbourhood.
        near = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        moved = spread_join(near, least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = spread_join(edges, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src, dst), two columns of one orderable type; component is the
    least node that can be reached. Nodes without an edge to another node aren't listed; null ends are ignored.
    Each round is written to the shared folder, so no lineage grows and a lost executor costs one round."""
    now = stored(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(most_rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        for large in (True, False):
            step = stored(_star(now, large), "edges")
            discard(now)
            now = step
        release(now.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

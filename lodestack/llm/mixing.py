"""Mixing sources to target weights by Pareto order sampling, after whole copies are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import bounded_broadcast, n_words, stored

#: Weights of the sources, in code point order of their names and repeating.
WEIGHTS = (5, 2, 1)
#: Ranks of a source are cut into so many cells, and the cell at the sample's edge into so many again; only the one of these at the
#: edge is ordered row by row.
CELLS = 4096
#: So many rows of the plan, one for each source and number of digits, are broadcast at most; more are joined by a shuffle.
MOST_PLANNED = 200_000


def _uniform(seed: str) -> Column:
    """A reproducible number in (0, 1) for an id, from 48 bits of its MD5; a null id counts by its text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce("text", F.lit(""))))
    return (F.conv(F.substring(F.md5(F.concat(own, F.lit(seed))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _digits(size: Column) -> Column:
    """Binary digits of a size; 1 for 0. A document's expected copies are in proportion to it."""
    return F.length(F.bin(size)).cast("long")


def with_level(rows: DataFrame, by: list[str], order: list[str], total: Column) -> DataFrame:
    """Adds t, the level at which least(cap, w * t) over the rows of a group comes to total, null if all rows stay at their caps;
    rows(cap, w). The capped rows are those of the smallest cap / w, so one ordered pass over a group finds the level."""
    group = Window.partitionBy(*by)
    before = group.orderBy("edge", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("edge", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0))
    rows = rows.withColumns(
        {
            "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left": F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    # The level if this row and all with a larger edge stay below their caps; the first that does fixes it.
    level = F.when(F.col("left") > 0, (total - F.col("spent")) / F.col("left"))
    first = F.min(F.when(level <= F.col("edge"), F.struct("edge", *order, level.alias("t")))).over(group)
    return rows.withColumn("t", first["t"]).drop("edge", "spent", "left")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = 3) -> DataFrame:
    """(key, source_size, target) for sizes(key, source, source_size), a row for each source.

    The targets are the shares of the total by weight; what exceeds most_copies times a source's size goes to the
    others by weight until none is above: a level t with target = min(cap, weight * t)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    caps = sizes.withColumns({"w": weight.cast("long"), "cap": F.col("source_size") * most_copies, "all": F.sum("source_size").over(Window.partitionBy())})
    caps = with_level(caps, [], ["source"], F.col("all"))
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce("t", F.lit(0.0)))
    return caps.select("key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = 3, seed: str = "mix") -> DataFrame:
    """Every row of docs(doc_id, text, source) with size, source_size, target, copies and taken.

    Within a source a document's expected copies are in proportion to the binary digits of its size, most_copies at most,
    at the level at which the expected words are the source's target. The whole part of them is allocated as certain copies;
    the rest is the document's own inclusion probability p of one copy more. Documents are ranked by u/(1-u) over p/(1-p),
    with u a hash of the id, and taken in that order until the words still due are reached; a document is taken if at least
    half of it is due, so a source misses its target by half a document at most. Ranks are cut into cells, whose words are
    summed first, and one cell into finer ones: only one of these is ordered, however large the source. Reruns agree.

    Null and empty texts have size 0 and are taken 0 words of; a null source is a source of its own, last in order. A null id's
    u is a hash of its text; ties in rank are ordered by id and size, and repeated rows are interchangeable. An empty table gives
    no rows. Further columns of docs are ignored."""
    base = stored(_placed(docs.select("doc_id", "text", "source"), seed).drop("text"), "mix")
    return _decided(base, *_plan(base, weights, most_copies)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), "copies", "p"
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as mix() takes it."""
    base = stored(_placed(docs.select("doc_id", "text", "source"), seed).drop("text"), "mix")
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))  # whatever the other columns are named
    rows = _decided(_placed(whole, seed).drop("text"), *_plan(base, weights, most_copies)).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def _placed(docs: DataFrame, seed: str) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = docs.withColumns({"_key": key, "_size": n_words(F.col("text")), "_u": _uniform(seed)})
    return rows.withColumn("_digits", _digits(F.col("_size")))


def _with_rank(rows: DataFrame) -> DataFrame:
    """Adds odds, a document's random odds over its inclusion odds, and its cell of the finer kind; both null where it can't be taken
    once more."""
    odds = F.when(F.col("p") > 0, F.col("_u") / (1 - F.col("_u")) / (F.col("p") / (1 - F.col("p"))))
    return rows.withColumn("odds", odds).withColumn("_cell", F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * CELLS**2), F.lit(CELLS**2 - 1)))


def _plan(base: DataFrame, weights: tuple[int, ...], most_copies: int) -> tuple[DataFrame, DataFrame]:
    """For each source and number of digits: target, certain copies and p. For each source: the words due to the ranks, and the
    cell where they end with the words before it."""
    kinds = base.groupBy(F.col("_key").alias("key"), "_digits").agg(F.first("source").alias("source"), F.sum("_size").alias("words"))
    kinds = stored(kinds, "kinds")
    sizes = kinds.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    plan = kinds.select("key", "_digits", "words").join(source_targets(sizes, weights, most_copies), "key")
    plan = plan.withColumns({"w": F.col("words") * F.col("_digits"), "cap": F.col("words") * most_copies})
    plan = with_level(plan, ["key"], ["_digits"], F.col("target"))
    expected = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(most_copies)), F.coalesce(F.col("t") * F.col("_digits"), F.lit(float(most_copies)))))
    plan = plan.withColumn("expected", expected).withColumns({"whole": F.floor("expected"), "p": F.col("expected") - F.floor("expected")})
    plan = stored(plan.select(F.col("key").alias("_key"), "_digits", "source_size", "target", "words", "whole", "p"), "plan")
    due = plan.groupBy("_key").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("due"))
    ranked = _with_rank(base.join(bounded_broadcast(plan.select("_key", "_digits", "p"), MOST_PLANNED), ["_key", "_digits"]))
    edges = due.withColumn("before", F.lit(0).cast("long"))
    for inside in (False, True):  # the edge among the coarse cells, then among the finer ones inside
        cells = ranked.where("_cell IS NOT NULL").withColumn("_cut", F.col("_cell") if inside else F.floor(F.col("_cell") / CELLS))
        if inside:
            cells = cells.join(bounded_broadcast(edges.select("_key", "edge"), MOST_PLANNED), "_key").where(F.floor(F.col("_cell") / CELLS) == F.col("edge"))
        cells = cells.groupBy("_key", "_cut").agg(F.sum("_size").alias("words"))
        cells = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("_key").orderBy("_cut")) - F.col("words"))
        cells = cells.join(edges, "_key").withColumn("upto", F.col("upto") + F.col("before")).where("upto < due")
        edges = stored(cells.groupBy("_key", "due").agg(F.max("_cut").alias("edge"), F.max("upto").alias("before")), "edges")
    return plan.drop("words"), edges


def _decided(rows: DataFrame, plan: DataFrame, edges: DataFrame) -> DataFrame:
    rows = _with_rank(rows.join(bounded_broadcast(plan, MOST_PLANNED), ["_key", "_digits"]).join(bounded_broadcast(edges, MOST_PLANNED), "_key", "left"))
    at_edge = F.coalesce(F.col("_cell") == F.col("edge"), F.lit(False))
    ranked = Window.partitionBy("_key").orderBy("odds", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.where(at_edge).withColumn("_upto", F.col("before") + F.sum("_size").over(ranked))
    near = near.withColumn("_extra", F.col("_upto") - F.col("_size") / 2 <= F.col("due")).drop("_upto")
    rest = rows.where(~at_edge).withColumn("_extra", F.coalesce(F.col("_cell") < F.col("edge"), F.lit(False)))
    return near.unionByName(rest).withColumn("copies", (F.col("whole") + F.col("_extra").cast("long")).cast("long"))

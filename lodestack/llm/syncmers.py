"""Document fingerprints: closed syncmers over words, context-free anchors for positional matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import BLANKS, UPPER, stored

#: Words of a k-mer, and of the substrings inside it.
K, S = 5, 2
#: Documents that are ordered together when each needs the one after it.
NEIGHBOURS = 1024
#: Quantiles of the ids that are looked at to cut them into ranges.
QUANTILES = 1024
LEAST = -(1 << 63)


def _words(text: Column) -> Column:
    """Words, A-Z in lower case."""
    plain = F.translate(text, UPPER + BLANKS, UPPER.lower() + " " * len(BLANKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def with_syncmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out, the closed syncmers of a text in order: array<struct<at int, hash long>>.

    The k-mer of words at a place is one if, of the S-word substrings inside it, the first or the last has the least
    hash; ties with an inner one count for the edge. Whether a k-mer is chosen depends on its K words alone, so equal passages
    have equal anchors whatever surrounds them. A text without a k-mer that is chosen, such as any of fewer than K words, has
    one anchor, its whole sequence, at 0; only a text without words has none."""
    w, h = f"_{out}_words", f"_{out}_inner"
    df = df.withColumn(w, _words(F.coalesce(F.col(text), F.lit(""))))
    n = F.size(w)
    inner = F.transform(F.slice(w, 1, F.greatest(n - (S - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1)))
    df = df.withColumn(h, inner)
    span = K - S  # the last substring's place in a k-mer
    at = lambda i: F.get(F.col(h), i)
    middle = lambda i: F.least(*[at(i + j) for j in range(1, span)])
    places = F.filter(F.sequence(F.lit(0), F.size(h) - span - 1), lambda i: F.least(at(i), at(i + span)) <= middle(i))
    many = F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(at(i), at(i + 2), at(i + span)).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.concat_ws(" ", w)).alias("hash")))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    df = df.withColumn(out, F.when(n >= K, many).otherwise(none))
    return df.withColumn(out, F.when((F.size(out) > 0) | (n == 0), F.col(out)).otherwise(whole)).drop(w, h)


def steps(anchors: str) -> Column:
    """What two fingerprints are matched by: each anchor with the next one and the words between the two, as a hash; a lone anchor
    stands for itself. So an anchor counts only where it lies in the same place relative to its neighbour, and a passage that
    was moved still matches."""
    a = F.col(anchors)
    pairs = F.transform(
        F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))),
        lambda x, i: F.xxhash64(F.get(a, i)["hash"], x["at"] - F.get(a, i)["at"], x["hash"]),
    )
    return F.array_distinct(F.when(F.size(a) == 1, F.transform(a, lambda x: x["hash"])).otherwise(pairs))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' steps; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def written(anchors: Column) -> Column:
    """A fingerprint as text, with every anchor: place, colon, hash in hexadecimal; blanks between anchors."""
    return F.array_join(F.transform(anchors, lambda x: F.concat_ws(":", x["at"].cast("string"), F.hex(x["hash"]))), " ")


def _cuts(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Lower edges, in (id, mix, salt), of ranges of about a QUANTILES-th of the rows each. An id that several quantiles name is
    cut by the hashes of its texts, and a text that several quantiles of these name by salt; what is collected is bounded."""
    ids = rows.agg(F.percentile_approx("id", [i / QUANTILES for i in range(QUANTILES + 1)], 20_000).alias("q"), F.min(F.when(F.col("id") > LEAST, F.col("id"))).alias("least")).first()
    ids, least = ids["q"] or [LEAST], ids["least"]
    often = {i: ids.count(i) for i in set(ids)}
    hot = [i for i, n in often.items() if n > 2]
    out = {(i, LEAST, LEAST) for i in often} | ({(least, LEAST, LEAST)} if least is not None else set())
    if hot:
        inside = rows.where(F.col("id").isin(hot)).groupBy("id").agg(F.percentile_approx("mix", [i / 64 for i in range(65)], 2000).alias("q"))
        for r in inside.collect():
            places = sorted(r["q"])[:: max(1, 64 // often[r["id"]])]
            for m in set(places):
                parts = places.count(m) if places.count(m) > 1 else 0
                out |= {(r["id"], m, LEAST)} | {(r["id"], m, LEAST + (j << 64) // parts) for j in range(1, parts)}
    return sorted(out)


def with_slot(docs: DataFrame, group: int = NEIGHBOURS) -> DataFrame:
    """docs(doc_id, text) with id, mix, salt, by which they are ordered, and slot, the number of their range in that order.

    Ids come in ascending order, null first; rows of one id in the order of a hash of their texts. Only rows equal in both, whose
    order makes no difference, are ordered by salt. So neither an id nor a text of a third of all rows makes one range."""
    # A salt is a hash of the row's number, which no result shows.
    # 52 bits of a hash, since quantiles are found among doubles.
    order = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "mix": F.shiftright(F.xxhash64("text"), 12), "salt": F.xxhash64(F.monotonically_increasing_id())}
    rows = docs.select("doc_id", "text").withColumns(order)
    n = docs.count()
    cuts = _cuts(rows.select("id", "mix", "salt"))
    fine = max(1, n // (group * max(1, len(cuts))))
    key = F.struct("id", "mix", "salt")
    # Which of the coarse runs of cuts, then which cut in it.
    runs = [cuts[i : i + 32] for i in range(0, len(cuts), 32)]
    cut = lambda x: F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(x, ("id", "mix", "salt"), strict=True)])
    found = lambda edges: F.greatest(F.size(F.filter(edges, lambda x: x <= key)) - 1, F.lit(0))
    rows = rows.withColumn("run", found(F.array(*[cut(r[0]) for r in runs])))
    slot = F.col("run") * 32 + found(F.get(F.array(*[F.array(*[cut(x) for x in r]) for r in runs]), F.col("run")))
    if fine > 1:
        # Each range evenly in the first column in which its ends differ.
        ends = [*cuts, (cuts[-1][0] + 1, LEAST, LEAST)]
        at = [next(j for j in range(3) if a[j] != b[j] or j == 2) for a, b in zip(ends, ends[1:], strict=False)]
        low = [float(a[j]) for a, j in zip(ends, at, strict=False)]
        wide = [float(b[j] if b[j] > a[j] else 1 << 63) - a[j] for a, b, j in zip(ends, ends[1:], at, strict=False)]
        table = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(x).alias("low"), F.lit(w).alias("wide")) for j, x, w in zip(at, low, wide, strict=True)])
        rows = rows.withColumn("slot", slot).withColumn("edge", F.get(table, F.col("slot")))
        value = F.get(F.array(*[F.col(c).cast("double") for c in ("id", "mix", "salt")]), F.col("edge.j"))
        part = F.floor((value - F.col("edge.low")) / F.col("edge.wide") * fine)
        slot = F.col("slot") * fine + F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1))
    return rows.withColumn("slot", slot.cast("long")).drop("run", "edge")


def with_next(docs: DataFrame, add, carried: list[str], group: int = NEIGHBOURS) -> DataFrame:
    """docs(doc_id, text) with what add(rows) makes of each text, and, of the next row by doc_id (after the last: the first), the
    columns carried, as next_<name>.

    The texts are dealt by slot once, made into anchors there, and ordered inside; only the first row of each range is carried to
    the range before, so no task orders the whole table."""
    placed = with_slot(docs, group)
    heads = stored(placed.groupBy("slot").agg(F.min(F.struct("id", "mix", "salt", "text")).alias("head")), "heads")
    # A row of a slot's number for each range, ordered as one: a thousandth of the rows, without texts.
    pairs = heads.select("slot").withColumn("before", F.lag("slot").over(Window.orderBy("slot")))
    last = heads.agg(F.max("slot")).first()[0]
    pairs = pairs.withColumn("before", F.coalesce("before", F.lit(last)))
    kind = docs.schema["doc_id"].dataType
    ends = pairs.join(heads, "slot").select(
        F.lit(None).cast(kind).alias("doc_id"), F.col("head.text").alias("text"), *[F.col(f"head.{c}").alias(c) for c in ("id", "mix", "salt")], F.col("before").alias("slot"), F.lit(1).alias("end")
    )
    rows = placed.select(*ends.columns[:-1], F.lit(0).alias("end")).union(ends).repartition("slot")
    inside = Window.partitionBy("slot").orderBy("end", "id", "mix", "salt")
    out = add(rows).withColumns({f"next_{c}": F.lead(c).over(inside) for c in carried})
    return out.where("end = 0").drop("end", "id", "mix", "salt", "slot")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and n_anchors.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many (or all) of the next
    document by ascending id, after the last the first. A fingerprint lists every anchor with its place in words; near_* is the
    Jaccard similarity of two fingerprints' steps, from each anchor to the next, and can be had from the written ones.

    A null text counts as empty: no anchors, an empty fingerprint, likeness 1 to another empty one and 0 to the rest. Rows of
    one id follow each other in the order of a hash of their texts, repeated rows in any; a null id comes first. A single row is
    its own next document; an empty table gives no rows. Other columns are ignored; very long texts are handled whole, in time
    linear in their length."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def add(rows: DataFrame) -> DataFrame:
        return with_syncmers(rows, "text", "anchors").withColumn("steps", steps("anchors"))

    near = with_next(docs.select("doc_id", text.alias("text")), add, ["text", "steps"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", "steps", "next_steps")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_syncmers(rows, "edited", "edited_anchors").drop("edited").withColumn("edited_steps", steps("edited_anchors"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("anchors")).alias("fingerprint"),
        written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("steps"), F.col("edited_steps")).alias("near_edited"),
        likeness(F.col("steps"), F.col("next_steps")).alias("near_next"),
        F.size("anchors").cast("long").alias("n_anchors"),
    )

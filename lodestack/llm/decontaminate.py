"""Benchmark decontamination: canonical templates, a hash join on their windows, and a check of the slots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import UPPER, stored

#: Units that follow a number; fixed values.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week "
    "weeks month months year years cent cents dollar dollars euro euros pound pounds percent km/h mph kmh hz khz mhz kb mb gb tb w kw "
    "kwh v j kj cal kcal mile miles meter meters metre metres inch inches foot feet gram grams liter liters litre litres"
).split()
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Stands for the punctuation that ends a sentence, after its last word; gone in the template.
END = "\ue003"
BLANK = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Settings:
    window: int = 5  # words of a template window
    coverage: float = 0.5  # share of an item's windows, with consistent slots, that contaminates a document
    literal: int = 3  # words of a whole window that are no placeholders, where an item has such windows
    most_broadcast: int = 500_000  # windows of the benchmark, 24 bytes each, that are broadcast; more are joined by a shuffle


def plain_words(text: Column) -> Column:
    """The text without punctuation around words and with one blank between them; the end of a sentence stays as a mark at
    its last word. It has as many words as its template."""
    out = F.regexp_replace(text, rf"[.!?]+(?<=[\p{{L}}\p{{N}}%][.!?]{{1,9}})[^\p{{L}}\p{{N}}{BLANK}]*(?=[{BLANK}]|$)", END)
    # Each run of blanks with the punctuation on either side is one blank.
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{BLANK}$€£%{END}]*[{BLANK}]+[^\p{{L}}\p{{N}}$€£]*", " ")
    return F.regexp_replace(out, rf"^[^\p{{L}}\p{{N}}$€£]+|[^\p{{L}}\p{{N}}$€£%{END}]+$", "")


def template(words: Column) -> Column:
    """Replaces numbers, units after numbers and names inside sentences by placeholders of their types, in the output of
    plain_words; other words are in lower case (A-Z). The number of words stays."""
    # Each pattern starts with what is rare, so that most places fail at once.
    out = F.regexp_replace(words, rf" (?<=[\p{{Ll}}\p{{Nd}}] )\p{{Lu}}[\p{{L}}'’-]*(?={END}? |{END}?$)", " " + NAME)
    out = F.regexp_replace(out, r"(?=[-+$€£\p{Nd}])(?<![\p{L}\p{N}])[-+$€£]*\p{Nd}+(?:[.,:/]\p{Nd}+)*%?", NUMBER)
    out = F.regexp_replace(out, rf"(?i){NUMBER}( ?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?={END}? |{END}?$)", NUMBER + "$1" + UNIT)
    return F.translate(out, UPPER + END, UPPER.lower())


def _hashes(words: str, n: int) -> Column:
    """Hashes of all windows of n words of an array column, in order; none if it has fewer."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, n)]))


def _windows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, at, h) for each window of n words of rows(key, words). Rows with fewer words aren't filtered out first: a
    condition on the words would be evaluated with them once more."""
    return rows.select(key, F.posexplode(_hashes("words", n)).alias("at", "h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The pairs of docs(doc_id, text) and benchmark(item_id, text) that share enough of the item: doc_id, item_id,
    matched and item_windows (of the item), coverage, slots and broken_slots.

    Both texts become templates; windows of `window` words (an item of fewer: all its words) are hashed and joined. Windows
    of a pair that lie at the same distance are one alignment, and in it each value of an item's slots must stand for one value
    in the document throughout, and each of the document's for one of the item, and the types must agree; a broken alignment
    doesn't count. A pair is returned if the other
    alignments cover at least `coverage` of the item's windows, so questions with other numbers, names or units are caught,
    and chance matches of a few words are not.

    Null and empty texts, and items without a word, match nothing. A null doc_id is a document of its own kind: its rows are
    judged together. Repeated rows give one pair for an id; items of equal text each give pairs. Empty tables give no rows;
    other columns are ignored. Only the benchmark's windows are broadcast, and only if a count bounds them."""
    n = settings.window
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("raw")).where("raw <> ''").distinct()
    items = items.select("item_id", F.split("raw", " ").alias("raw"), F.split(template(F.col("raw")), " ").alias("words"))
    same = F.when(F.size("raw") == F.size("words"), True).otherwise(F.raise_error(F.concat(F.lit("a template of other length than its item: "), F.col("item_id"))).cast("boolean"))
    items = stored(items.where(same), "items")
    # Items shorter than a window are matched whole, at their own length.
    lengths = [n] + [r[0] for r in items.where(F.size("words") < n).select(F.size("words").alias("n")).distinct().collect()]
    long = items.where(F.size("words") >= n)
    parts = [_windows(long, "item_id", n).withColumn("n", F.lit(n))]
    parts += [_windows(items.where(F.size("words") == m), "item_id", m).withColumn("n", F.lit(m)) for m in lengths[1:]]
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.union(p)
    # A window of little but placeholders fits anything of its shape: it counts only if its item has no other.
    plain = F.size(F.filter(F.slice("words", F.col("at") + 1, n), lambda w: ~w.rlike(f"[{NUMBER}{NAME}{UNIT}]")))
    grams = grams.join(items.select("item_id", "words"), "item_id").withColumn("plain", (F.col("n") < n) | (plain >= settings.literal))
    grams = grams.withColumn("any", F.max("plain").over(Window.partitionBy("item_id"))).where("plain OR NOT any")
    grams = stored(grams.select("item_id", F.col("at").alias("item_at"), "h", "n"), "grams")
    total = grams.groupBy("item_id").agg(F.countDistinct("h").alias("item_windows"))
    small = grams.count() <= settings.most_broadcast
    whole = docs.select("doc_id", plain_words(F.col("text")).alias("raw"))
    words = whole.select("doc_id", F.split(template(F.col("raw")), " ").alias("words"))
    hits = None
    for m in lengths:
        known = grams.where(F.col("n") == m).drop("n")
        distinct = known.select("h").distinct()
        # Each place of a document is looked up once among distinct windows; only hits meet the items.
        found = _windows(words, "doc_id", m).join(F.broadcast(distinct) if small else distinct, "h")
        found = found.withColumn("n", F.lit(m))
        hits = found if hits is None else hits.union(found)
    hits = stored(hits.select("doc_id", F.col("at").alias("doc_at"), "h", "n"), "hits")
    hits = hits.join(grams, ["h", "n"]).select("doc_id", "item_id", "h", "n", "doc_at", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift"))

    # Slots: only windows with a placeholder, of documents that were hit, need the documents' words again.
    marked = stored(items.select("item_id", F.posexplode("words").alias("place", "word"), "raw").where(F.col("word").rlike(f"[{NUMBER}{NAME}{UNIT}]"))
                    .select("item_id", "place", "word", F.translate(F.get("raw", F.col("place")), END, "").alias("value")), "slots")
    slots = hits.join(marked, "item_id").where("place >= item_at AND place < item_at + n")
    slots = stored(slots.select("doc_id", "item_id", "shift", "place", "word", "value", (F.col("place") + F.col("shift")).alias("doc_place")).distinct(), "slots")
    needed = slots.select("doc_id").distinct()
    texts = whole.join(needed, "doc_id", "left_semi").select("doc_id", F.split("raw", " ").alias("doc_words"))
    values = slots.join(texts, "doc_id").withColumn("doc_value", F.translate(F.get("doc_words", F.col("doc_place")), END, ""))
    # A row for each pair of values in an alignment; a value that stands in two pairs of its type is broken.
    met = values.select("doc_id", "item_id", "shift", "word", "value", "doc_value").distinct()
    both = F.explode(F.array(F.struct(F.lit(True).alias("of_item"), F.col("value").alias("v")), F.struct(F.lit(False).alias("of_item"), F.col("doc_value").alias("v"))))
    by_value = met.select("doc_id", "item_id", "shift", "word", both.alias("x")).groupBy("doc_id", "item_id", "shift", "word", "x").agg(F.count("*").alias("kinds"))
    slotted = by_value.groupBy("doc_id", "item_id", "shift")
    broken = slotted.agg(F.count_if(F.col("x.of_item")).alias("slots"), F.count_if(F.col("kinds") > 1).alias("broken"))
    runs = hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("h").alias("found"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "item_id", "shift")]
    runs = runs.alias("r").join(broken.alias("b"), same, "left").select("r.*", "b.slots", "b.broken")
    fine = F.coalesce(F.col("broken"), F.lit(0)) == 0
    runs = runs.select("doc_id", "item_id", F.when(fine, F.col("found")).otherwise(F.array().cast("array<bigint>")).alias("found"), "slots", "broken")
    pairs = runs.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("matched"),
        F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"),
        F.coalesce(F.sum("broken"), F.lit(0)).alias("broken_slots"),
    )
    pairs = pairs.join(total, "item_id").withColumn("coverage", F.col("matched") / F.col("item_windows"))
    return pairs.where(F.col("coverage") >= settings.coverage).select("doc_id", "item_id", "matched", "item_windows", "coverage", "slots", "broken_slots")

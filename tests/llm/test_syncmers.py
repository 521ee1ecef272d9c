import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import syncmers as y

from .common import odd, table, words


def h(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def slow(text):
    w = (text or "").encode().lower().split()
    inner = [h(*w[i : i + y.S]) for i in range(len(w) - y.S + 1)]
    span, out = y.K - y.S, []
    for i in range(len(w) - y.K + 1):
        part = inner[i : i + span + 1]
        if min(part) in (part[0], part[-1]):
            out.append((i, h(inner[i], inner[i + 2], inner[i + span])))
    return out or ([(0, h(b" ".join(w)))] if w else [])


def like(a, b):
    """Of two lists of (place, hash)."""
    a, b = ({(p[1], q[0] - p[0], q[1]) for p, q in zip(s, s[1:], strict=False)} or {x for _, x in s} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def read(fingerprint):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(int(at), signed(int(x, 16))) for at, _, x in (part.partition(":") for part in fingerprint.split())]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h((r[1] or "").encode())))


def expected(rows):
    order = ordered(rows)
    out = []
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(slow(t), slow(edited)), 9), round(like(slow(t), slow(after)), 9), len(slow(t)), str(slow(t)), str(slow(edited))))
    return sorted(out)


def got(spark, rows):
    found = y.fingerprints(table(spark, rows)).collect()
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["n_anchors"], str(read(r["fingerprint"])), str(read(r["edited_fingerprint"]))) for r in found)


def test_syncmers_match_the_definition(spark):
    texts = [words(n, n, 40) for n in (0, 1, 4, 5, 6, 50, 400)] + ["a a a a a a a a", "É é x\ty\x0bz A b", None]
    df = y.with_syncmers(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "m")
    for r in df.collect():
        assert [tuple(x) for x in r["m"]] == slow(texts[r["i"]])


def test_anchors_do_not_depend_on_their_surroundings(spark):
    passage = words(60, 5, 9999)
    df = spark.createDataFrame([(f"{words(n, n)} {passage} {words(9, n + 1)}",) for n in (3, 17, 40)], "t string")
    sets = [{x["hash"] for x in r["m"]} for r in y.with_syncmers(df, "t", "m").collect()]
    inside = {x for _, x in slow(passage)}
    assert inside and all(inside <= s for s in sets)


@pytest.mark.parametrize("group", [1024, 3])
def test_fingerprints_match_brute_force(spark, group, monkeypatch):
    r = random.Random(3)
    rows = [(i, words(r.randrange(0, 80), i, 60), "en", "a") for i in r.sample(range(-5000, 10**6), 60)] + [(10**12, words(30, 1), "en", "a"), (10**12 + 1, words(30, 1), "en", "a")]
    monkeypatch.setattr(y.with_next, "__defaults__", (group,))
    assert got(spark, rows) == expected(rows)


def test_short_texts_have_a_fingerprint_of_their_own(spark):
    rows = [(i, words(1 + i % 12, i, 9999), "en", "a") for i in range(240)]
    found = got(spark, rows)
    assert found == expected(rows)
    assert all(f[5] > 0 for f in found) and len({f[6] for f in found}) == 240 and all(f[4] == 0 for f in found)


def test_places_matter(spark):
    """Anchors at other distances from each other don't match."""
    a, b, c = (words(12, n, 9999) for n in (1, 2, 3))
    one, two = slow(f"{a} {b}"), slow(f"{a} {c} {b}")
    assert {x for _, x in slow(a)} | {x for _, x in slow(b)} <= {x for _, x in two} and 0 < like(one, two) < 1
    near = {r["doc_id"]: r["near_next"] for r in y.fingerprints(table(spark, [(1, f"{a} {b}", "", ""), (2, f"{a} {c} {b}", "", "")])).collect()}
    assert near[1] == pytest.approx(like(one, two))


@pytest.mark.parametrize("group", [1024, 4])
def test_hot_ids_and_texts_are_cut(spark, group, monkeypatch):
    monkeypatch.setattr(y.with_next, "__defaults__", (group,))
    monkeypatch.setattr(y, "QUANTILES", 32)
    rows = [(None, words(3 + i % 7, i), "en", "a") for i in range(150)] + [(7, "the same words again and again", "en", "a")] * 150 + [(1000 + i, words(8, i), "en", "a") for i in range(150)]
    assert got(spark, rows) == expected(rows)
    slots = y.with_slot(table(spark, rows).select("doc_id", "text"), group).groupBy("slot").count().collect()
    assert max(r["count"] for r in slots) < 60 and len(slots) > 12


def test_odd_rows_and_empty_tables(spark):
    rows = odd(4000)
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == [] and got(spark, [(5, "a b c d e f", "en", "a")])[0][4] == 1.0
    assert got(spark, [(None, "x", "en", "a"), (None, None, "en", "a")]) == expected([(None, "x", 0, 0), (None, None, 0, 0)])


def test_every_row_has_the_next_one(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    near = y.with_next(many, lambda rows: rows, ["text"], 16)
    assert near.where("next_text = concat('w', (doc_id + 1) % 3000)").count() == 3000

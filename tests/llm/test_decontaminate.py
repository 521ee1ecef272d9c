import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import decontaminate as d

from .common import odd, table, words

ITEM = "Alice has 12 apples and buys 3 kg of pears from Bob. How many apples does Alice have after 12 days?"
SAME = "Carol has 40 apples and buys 7 kg of pears from Dave. How many apples does Carol have after 40 days?"
BROKEN = "Carol has 40 apples and buys 7 kg of pears from Dave. How many apples does Erin have after 99 days?"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def found(spark, docs, *texts, **more):
    return {(r["doc_id"], r["item_id"]): r for r in d.contaminated(docs, bench(spark, *texts), d.Settings(**more)).collect()}


def templated(spark, text):
    raw = d.plain_words(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(raw.alias("r"), d.template(raw).alias("t")).first()
    assert len(r["r"].split(" ")) == len(r["t"].split(" "))
    return r["t"].replace(d.NUMBER, "<n>").replace(d.NAME, "<name>").replace(d.UNIT, "<u>")


def test_templates(spark):
    assert templated(spark, "We saw Alice, 12 kg (of) pears!  Then 3.5km at $1,200.50.") == "we saw <name> <n> <u> of pears then <n><u> at <n>"
    assert templated(spark, 'He said "No." Then | went -- on 5% of A1 x2') == "he said <name> then went on <n> of a1 x2"
    assert templated(spark, "...") == "" and templated(spark, "") == ""


def test_other_numbers_and_names_are_the_same_question(spark):
    docs = table(spark, [(1, f"{words(30, 1)}. {SAME} {words(30, 2)}", "en", "a"), (2, words(80, 3), "en", "a"), (3, ITEM, "en", "a"), (4, None, "en", "a")])
    got = found(spark, docs, ITEM)
    assert set(got) == {(1, 0), (3, 0)} and got[3, 0]["coverage"] == 1 and got[1, 0]["broken_slots"] == 0


def test_a_value_must_stand_for_one_value(spark):
    docs = table(spark, [(1, SAME, "en", "a"), (2, BROKEN, "en", "a")])
    got = found(spark, docs, ITEM)
    assert set(got) == {(1, 0)}


def test_near_copies_short_items_and_chance(spark):
    item = words(40, 5)
    edited = item.split()
    edited[20] = "changed"
    docs = table(spark, [(1, f"a b {' '.join(edited)} c", "en", "a"), (2, " ".join(item.split()[:12]), "en", "a"), (3, "see two words", "en", "a"), (4, "two", "en", "a")])
    assert set(found(spark, docs, item, "two words", None, "", "???")) == {(1, 0), (3, 1)}


def test_shuffled_when_the_benchmark_is_large(spark):
    docs = table(spark, [(1, SAME, "en", "a"), (2, words(50, 2), "en", "a")])
    assert set(found(spark, docs, ITEM, most_broadcast=0)) == {(1, 0)}


def test_windows_of_little_but_placeholders_do_not_count(spark):
    item = "We met Ann Bob Cy Dee Eve Fay Gus Hal at noon by the old mill"
    docs = table(spark, [(1, "We met Kim Lee Moe Ned Oz Pat at noon but left", "en", "a"), (2, item.replace("Ann", "Kim"), "en", "a")])
    assert found(spark, docs, item).keys() == {(2, 0)} and found(spark, docs, item, literal=0).keys() == {(1, 0), (2, 0)}


def brute(docs, items, n=5):
    """Verbatim items without placeholders: shares of item windows in a document."""
    out = {}
    grams = lambda t, m: [tuple(t[i : i + m]) for i in range(len(t) - m + 1)]
    for i, a in docs:
        for j, b in items:
            m = min(n, len(b.split()))
            want = set(grams(b.split(), m))
            share = len(want & set(grams(a.split(), m))) / len(want)
            if share >= 0.5:
                out[i, j] = share
    return out


def test_matches_brute_force(spark):
    items = [(j, words(10 + 3 * j, 100 + j, 60)) for j in range(6)]
    docs = []
    for i in range(40):
        cut = items[i % 6][1].split()
        docs.append((i, words(20, i, 60) + " " + " ".join(cut[: len(cut) * (i % 5) // 4]) + " " + words(10, 900 + i, 60)))
    got = found(spark, table(spark, [(i, t, "en", "a") for i, t in docs]), *[t for _, t in items])
    assert {k: pytest.approx(v["coverage"]) for k, v in got.items()} == brute(docs, items)


def test_two_values_may_not_become_one(spark):
    docs = table(spark, [(1, SAME.replace("7 kg", "40 kg"), "en", "a"), (2, SAME.replace("Dave", "Carol"), "en", "a"), (3, SAME, "en", "a")])
    assert set(found(spark, docs, ITEM)) == {(3, 0)}


LITERAL = "the of old mill river brings green stones under every second bridge while people count boats and birds until dark".split()


def question(seed, n):
    """Words, numbers and names; it starts with a word, and names follow words or numbers."""
    r = random.Random(seed)
    return [r.choice(LITERAL)] + [r.choice([r.choice(LITERAL)] * 5 + [str(r.randrange(5))] + [r.choice(["Ann", "Bob", "Cy"])]) for _ in range(n - 1)]


def as_template(tokens):
    return ["<n>" if t.isdigit() else "<name>" if t[0].isupper() else t for t in tokens]


def brute_templates(doc, item, n=5, literal=3, coverage=0.5):
    """Whether a document holds an item under other numbers and names, by all alignments one after the other."""
    a, b = as_template(doc), as_template(item)
    windows = [(j, tuple(b[j : j + n])) for j in range(len(b) - n + 1)]
    good = [w for w in windows if sum(x[0] != "<" for x in w[1]) >= literal] or windows
    hit = set()
    for shift in range(-len(b), len(a)):
        mine = [(j, w) for j, w in good if 0 <= j + shift <= len(a) - n and tuple(a[j + shift : j + shift + n]) == w]
        places = {p for j, _ in mine for p in range(j, j + n) if b[p][0] == "<"}
        pairs = {(b[p], item[p], doc[p + shift]) for p in places}
        if len({x[:2] for x in pairs}) == len(pairs) == len({(x[0], x[2]) for x in pairs}):
            hit |= {w for _, w in mine}
    return len(hit) / len({w for _, w in good}) >= coverage


def test_templates_and_slots_match_brute_force(spark):
    items = [question(j, 8 + 4 * j) for j in range(6)]
    docs = []
    for i in range(90):
        r = random.Random(i)
        change = {str(k): str(r.randrange(5 if i % 3 else 50)) for k in range(5)} | {x: r.choice(["Kim", "Lee", "Moe"][: 1 + i % 3]) for x in ("Ann", "Bob", "Cy")}
        copy = [change.get(t, t) if r.random() < 0.97 else r.choice(LITERAL) for t in items[i % 6]]
        docs.append(question(1000 + i, 6) + copy[: len(copy) if i % 4 else len(copy) * 2 // 3] + question(2000 + i, 5))
    got = found(spark, table(spark, [(i, " ".join(d), "en", "a") for i, d in enumerate(docs)]), *[" ".join(t) for t in items])
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if brute_templates(d, t)}
    assert set(got) == want and 20 < len(want) < 90


def test_odd_rows_and_empty_tables(spark):
    docs = table(spark, odd())
    got = found(spark, docs, odd()[7][1], "no id here but some words to read")
    assert set(got) == {(6, 0), (7, 0), (None, 1)}
    assert found(spark, docs.limit(0), ITEM) == {} and found(spark, docs) == {}

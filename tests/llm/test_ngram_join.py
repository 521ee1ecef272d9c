import itertools
import random

import numpy as np
import pytest

from lodestack.llm import ngram_join as j

from .common import odd, table, words
from .test_components import find


def shingles(text, k=4):
    t = (text or "").encode().lower().split()
    return {tuple(t)} if 0 < len(t) < k else {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if t else set()


def brute(rows, k=4, percent=85):
    """{row number: (set size, component)}; rows of one id are one node."""
    sets = [shingles(t, k) for _, t in rows]
    edges = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            edges.append((rows[a][0], rows[b][0]))
    root = find([e for e in edges if None not in e])
    return sorted((i, len(s), root.get(i, i)) for (i, _), s in zip(rows, sets, strict=True))


def got(spark, rows, settings=j.Settings()):
    out = j.join(table(spark, [(i, t, "en", "a") for i, t in rows]), settings)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect())


def edit(text, share, seed):
    r = random.Random(seed)
    t = text.split()
    for i in r.sample(range(len(t)), max(1, int(len(t) * share))):
        t[i] = f"e{r.randrange(10**6)}"
    return " ".join(t)


def family(base, n, shares, start):
    text = words(base, start, 5000)
    return [(start + i, text if not s else edit(text, s, start + i)) for i, s in enumerate(itertools.islice(itertools.cycle(shares), n))]


def test_families_at_the_border(spark):
    rows = [(9000 + i, words(20 + i, 9000 + i, 3000)) for i in range(40)]
    rows += family(40, 12, (0, 0.03, 0.05), 100) + family(300, 14, (0, 0.005, 0.01, 0.02, 0.04), 200) + family(7, 6, (0, 0.1), 300) + family(1500, 8, (0, 0.004, 0.01, 0.02), 400)
    text = words(25, 1)  # links are exact at 85 of 100: one more or one fewer shingle decides
    rows += [(500 + i, " ".join(text.split()[: 25 - i])) for i in range(8)]
    assert got(spark, rows) == brute(rows)
    loose = j.Settings(words=5, percent=80)
    assert got(spark, rows, loose) == brute(rows, 5, 80)


def test_crowds_of_near_copies_and_shared_passages(spark):
    rows = family(120, 90, (0.008, 0.016, 0.03), 1000)
    passage = words(55, 77)
    rows += [(2000 + i, f"{words(40, 3000 + i, 9000)} {passage} {words(40 + i, 4000 + i, 9000)}") for i in range(60)]
    rows += [(3000 + i, rows[0][1].upper() if i % 2 else rows[0][1]) for i in range(50)]
    want = brute(rows)
    for settings in (j.Settings(sample=60), j.Settings(crowd=8, sample=60), j.Settings(crowd=8, tile=30), j.Settings(crowd=8, tile_shingles=2000, tile_key=7), j.Settings(crowd=10**9, tile_key=16)):
        assert got(spark, rows, settings) == want


def test_odd_rows_and_empty_tables(spark):
    rows = [(i, t) for i, t, *_ in odd(3000)]
    out = got(spark, rows[2:])
    assert out == brute(rows[2:])
    none = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.join(table(spark, odd(50))).where("doc_id IS NULL").collect()}
    assert none == {(None, 5, None), (None, 0, None)}
    assert got(spark, []) == []


def test_a_null_id_joins_its_equals(spark):
    assert j.join(table(spark, [(None, "a b c d e", "en", "a"), (4, "A b c d e", "en", "a")])).where("component_id = 4 AND class_id = 4").count() == 2


def test_pruning_never_loses_a_pair():
    rng = np.random.default_rng(5)
    s, order = j.Settings(), j.Order([])
    for n in (6, 20, 55, 66, 100, 127, 200, 700, 1020, 4000):
        for _ in range(80):
            base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = rng.integers(0, max(2, int(0.2 * n)))
            other = np.unique(np.concatenate([base[: len(base) - gone] if rng.random() < 0.5 else rng.permutation(base)[gone:], rng.integers(0, 1 << 63, rng.integers(0, max(2, int(0.1 * n)))).astype(np.uint64)]))
            if not len(other):
                continue
            a, b = (j.Member.of(i, i, len(x), j.bitmap(x[: s.shown(len(x))])) for i, x in enumerate((base, other)))
            both = len(np.intersect1d(base, other))
            if s.enough(both, len(base), len(other)):
                assert j.possible(a, b, s)
                assert len(np.intersect1d(j.keys_of(base, order, s), j.keys_of(other, order, s)))


def test_differences_are_bounded():
    for percent in (80, 85, 90):
        s = j.Settings(percent=percent)
        for n in range(1, 400):
            worst = max((n + b - 2 * both for b in range(1, 2 * n + 2) for both in [s.needed(n, b)] if both <= min(n, b)), default=0)
            assert s.apart(n) >= worst


@pytest.mark.parametrize("n", [5, 40, 300])
def test_trees_give_all_possible_pairs(n):
    rng = np.random.default_rng(n)
    s = j.Settings()
    members = []
    for i in range(n):
        x = np.unique(rng.integers(0, 400, int(rng.integers(20, 60))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        members.append(j.Member.of(i, int(rng.integers(0, n)), len(x), j.bitmap(x[: s.shown(len(x))])))
    members.sort(key=lambda m: (m.n, m.cid))
    got = {(min(a.cid, b.cid), max(a.cid, b.cid)) for a, b in j.tree_pairs(iter(members), s)}
    want = {(min(a.cid, b.cid), max(a.cid, b.cid)) for a, b in itertools.combinations(members, 2) if a.part != b.part and j.possible(a, b, s)}
    assert got == want


def test_a_passage_of_many_documents_makes_no_crowd(spark):
    line, base = words(14, 1), words(60, 2)
    rows = [(i, f"{words(50, 1000 + i, 10**6)} {line}", "en", "a") for i in range(300)] + [(1000 + i, f"{base} x{i}", "en", "a") for i in range(100)]
    settings = j.Settings()
    docs = table(spark, rows)
    order = spark.sparkContext.broadcast(j.Order(j.common_shingles(docs, settings)))
    members = j.crowds_of(j.describe(docs, order, settings).selectExpr("*", "doc_id AS rep"), settings).join(j.describe(docs, order, settings).select("cid", "doc_id"), "cid")
    assert {r["doc_id"] for r in members.select("doc_id").distinct().collect()} == set(range(1000, 1100))
    assert got(spark, [r[:2] for r in rows]) == brute([r[:2] for r in rows])

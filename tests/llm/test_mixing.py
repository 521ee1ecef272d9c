import pytest
from pyspark.sql import functions as F

from lodestack.llm import mixing

from .common import odd, table, words


def levels(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing again and again; sizes in code point order of the sources."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        above = {i for i in free if share[i] > most * sizes[i]}
        if not above:
            return [share.get(i, float(most * sizes[i])) for i in range(len(sizes))]
        capped |= above


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 500, 7], [1, 1, 1, 1000], [0, 50, 3], [5], [0, 0], [300, 1, 2, 3, 4, 5000]])
def test_targets_match_resharing(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", f"s{i}", n) for i, n in enumerate(sizes)], "key string, source string, source_size long")
    got = {r["key"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(levels(sizes))


def test_null_comes_last_in_code_point_order(spark):
    docs = table(spark, [(i, words(50, i), "en", s) for i, s in enumerate(["Z", "a", "\U0001f600", "\ue000", "", None])])
    got = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    assert [got[i] for i in range(6)] == pytest.approx([300 * w / 16 for w in (2, 1, 2, 5, 5, 1)])


def test_takes_come_near_targets_and_repeat(spark):
    docs = table(spark, [(i, words(5 + i % 90, i), "en", f"s{i % 4 if i % 3 else 0}") for i in range(3000)], 7)
    rows = mixing.mix(docs)
    for r in rows.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want"), F.max("size").alias("most")).collect():
        assert abs(r["t"] - r["want"]) <= r["most"]
    assert rows.where("taken > 3 * size OR taken % greatest(size, 1) <> 0").count() == 0
    assert sorted(rows.collect()) == sorted(mixing.mix(docs.repartition(2)).collect())
    again = mixing.mixed(docs).groupBy("doc_id").count()
    assert {r["doc_id"]: r["count"] for r in again.collect()} == {r["doc_id"]: r["copies"] for r in rows.where("copies > 0").collect()}
    clash = docs.withColumns({c: F.lit(c) for c in ("target", "_key", "whole", "copies", "edge", "_row")})
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).where("_size <> 7 OR copies <> 'copies' OR target <> 'target'").count() == 0


def levels_by_halving(words, target, most=3):
    """Expected copies by number of digits: the level by halving an interval."""
    taken = lambda t: sum(min(most, t * d) * n for d, n in words.items())
    lo, hi = 0.0, float(most)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if taken(mid) < target else (lo, mid)
    return {d: min(float(most), hi * d) for d in words}


def ranked_by_hand(spark, docs, odds=True):
    """{doc_id: copies} by a plain Pareto sample of each source, with the odds or, for comparison, without them."""
    rows = [r.asDict() for r in mixing._placed(docs, "mix").select("doc_id", "_key", "_size", "_digits", "_u").collect()]
    target = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    out = {}
    for key in {r["_key"] for r in rows}:
        mine = [r for r in rows if r["_key"] == key]
        words = {}
        for r in mine:
            words[r["_digits"]] = words.get(r["_digits"], 0) + r["_size"]
        want = levels_by_halving(words, target[mine[0]["doc_id"]])
        for r in mine:
            r["whole"], r["p"] = divmod(round(want[r["_digits"]], 9), 1)
        due = target[mine[0]["doc_id"]] - sum(r["whole"] * r["_size"] for r in mine)
        rank = lambda r: r["_u"] / (1 - r["_u"]) / (r["p"] / (1 - r["p"]) if odds else 1)
        for r in sorted((r for r in mine if r["p"] > 1e-8), key=rank):
            r["whole"] += r["_size"] / 2 <= due
            due -= r["_size"]
        out |= {r["doc_id"]: int(r["whole"]) for r in mine}
    return out


def mixture(spark):
    return table(spark, [(i, words(1 + (i * 37) % 61 * (1 + i % 5), i), "en", f"s{i % 3 if i % 4 else 0}") for i in range(900)], 5)


@pytest.mark.parametrize("cells", [4096, 8, 1])
def test_the_mix_is_a_pareto_sample(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    docs = mixture(spark)
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert got == ranked_by_hand(spark, docs)
    assert got != ranked_by_hand(spark, docs, odds=False)  # the inclusion odds decide


def test_longer_documents_are_included_more_often(spark):
    rows = mixing.mix(mixture(spark)).where("p > 0").groupBy("source_size").agg(F.corr("size", F.col("copies")).alias("c"), F.countDistinct("p").alias("kinds")).collect()
    assert rows and all(r["kinds"] > 3 and r["c"] > 0 for r in rows)


def test_odd_rows_and_empty_tables(spark):
    docs = table(spark, odd())
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd()) and all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode().split()) for _, t, *_ in odd())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mix(table(spark, [(1, "", "en", "a"), (2, None, "en", None)])).where("target = 0 AND taken = 0").count() == 2

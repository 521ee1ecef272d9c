import numpy as np
import pytest

from lodestack.operators import neighbours


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(ids[i]) if ids is not None else i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")


def brute(x, k):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    s = u @ u.T
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], str(j)))
        out[str(i)] = [(str(j), s[i, j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("block", [1000, 40, 7])
def test_exact_whatever_the_blocks(spark, block):
    x = np.random.default_rng(1).normal(size=(90, 12)).astype(np.float32).astype(np.float64)
    got = {}
    for r in neighbours.exact_top_k(frame(spark, x), 5, block).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["score"]))
    for i, w in brute(x, 5).items():
        assert [a for a, _ in got[i]] == [a for a, _ in w]
        assert np.allclose([s for _, s in got[i]], [s for _, s in w])


def test_ties_duplicates_and_zero_vectors(spark):
    x = np.zeros((30, 8))
    for i in range(29):
        x[i, np.random.default_rng(i % 7).permutation(8)[:4]] = 0.5
    for block in (100, 4):
        got = {}
        for r in neighbours.exact_top_k(frame(spark, x), 6, block).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["neighbour"])
        assert got == {i: [a for a, _ in w] for i, w in brute(x, 6).items()}
        assert "29" not in got["29"] and len(got["29"]) == 6 and "7" in got["0"] and "0" not in got["0"]


def test_queries_and_short_lists(spark):
    v = frame(spark, np.eye(3))
    rows = neighbours.exact_top_k(v, 50, queries=spark.createDataFrame([(1,)], "id long"))
    lists = neighbours.neighbour_lists(rows).collect()
    assert [(r["id"], r["neighbours"], r["scores"]) for r in lists] == [("1", ["0", "2"], [0.0, 0.0])]
    assert neighbours.exact_top_k(v.limit(0), 5).count() == 0


def test_measures(spark):
    t = spark.createDataFrame([("a", str(i), 1 - i / 10, i) for i in range(1, 5)] + [("b", "1", 0.5, 1)], "id string, neighbour string, score double, rank int")
    f = spark.createDataFrame([("a", "1", 0.9, 1), ("a", "9", 0.60005, 2), ("a", "8", 0.1, 3)], "id string, neighbour string, score double, rank int")
    got = {r["id"]: (r["strict"], r["tolerant"]) for r in neighbours.recall_at(f, t, 4).collect()}
    assert got == {"a": (0.25, 0.5), "b": (0.0, 0.0)}
    assert {r["id"]: r["jaccard"] for r in neighbours.churn(t, f, 4).collect()} == {"a": pytest.approx(1 / 6)}
    dup = frame(spark, np.array([[1, 0], [1, 0], [0, 1]]))
    assert {tuple(r) for r in neighbours.duplicate_groups(dup).collect()} == {("1", 1, 1), ("2-4", 1, 2)}
    names = spark.createDataFrame([(d,) for d in (1, 2, 3, 4, 255, 256, 9000)], "d long").select(neighbours.degree_bucket(__import__("pyspark").sql.functions.col("d")))
    assert [r[0] for r in names.collect()] == ["1", "2-3", "2-3", "4-7", "128-255", "256+", "256+"]
    want = spark.createDataFrame([(0,), (7,)], "id long")
    assert tuple(neighbours.coverage(want, dup).first()) == (2, 1, 0.5)
    assert {r["id"]: r["embedding"] for r in neighbours.zero_filled(want, dup, 2).collect()}[7] == [0, 0]


def test_half_precision_rounds_and_checks(spark):
    got = neighbours.half_precision(frame(spark, [[0.1, 1e-9]])).first()["embedding"]
    assert got == [float(np.float16(np.float32(0.1))), 0.0]
    with pytest.raises(Exception, match="dimensions"):
        neighbours.half_precision(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>").coalesce(1)).count()


def test_bootstrap_holds_the_mean_and_repeats(spark):
    rows = spark.createDataFrame([(i, float(i % 10)) for i in range(500)], "id long, x double")
    a = neighbours.bootstrap(rows, "x", 400).first()
    assert a["mean"] == 4.5 and a["low"] < 4.5 < a["high"] and 0.3 < a["high"] - a["low"] < 0.8
    assert neighbours.bootstrap(rows.repartition(3), "x", 400).first() == pytest.approx(a)
    assert neighbours.hash_sample(rows, "id", 20).count() == 20
    assert neighbours.hash_sample(rows.repartition(5), "id", 20).collect() == neighbours.hash_sample(rows, "id", 20).collect()


def test_rerank_accept_and_buckets(spark):
    x = np.random.default_rng(4).normal(size=(40, 6))
    v = frame(spark, x)
    truth = neighbours.exact_top_k(v, 5)
    wide = neighbours.exact_top_k(v, 12).select("id", "neighbour")
    key = lambda df: sorted((r["id"], r["neighbour"], r["rank"], round(r["score"], 5)) for r in df.collect())
    assert key(neighbours.reranked(wide, v, 5)) == key(truth)
    fine = neighbours.accepted(neighbours.neighbour_lists(truth), truth).first()
    assert fine["queries"] == 40 and fine["recall"] == 1 and fine["violations"] == 0 and fine["worst_error"] < 1e-6
    lost = neighbours.accepted(neighbours.neighbour_lists(truth.where("rank <> 2")), truth).first()
    assert lost["recall"] == 0.8 and lost["violations"] == 40
    r = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 0.5)], "id string, strict double, tolerant double")
    d = spark.createDataFrame([("a", 2), ("b", 3)], "id string, degree long")
    assert tuple(neighbours.recall_by_degree(r, d).first()) == ("2-3", 2, 0.5, 0.75)


def test_spool_stops_and_goes_on(spark, tmp_path):
    v = frame(spark, np.random.default_rng(5).normal(size=(50, 4)))
    root, calls = f"file://{tmp_path}/spool", []
    assert neighbours.spooled_top_k(v, root, 4, 10, lambda: len(calls) >= 2 or calls.append(1)) is None
    done = neighbours.spooled_top_k(v, root, 4, 10)
    want = neighbours.exact_top_k(v, 4)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        neighbours.spooled_top_k(v.limit(49), root, 4, 10)

from lodestack.llm.common import spread_join, without

from .common import odd, table


def test_without_is_an_anti_join(spark, monkeypatch):
    from lodestack.llm import common

    docs = table(spark, odd(50) + [(100 + i, f"t{i}", "en", "a") for i in range(300)])
    for bits in (1 << 24, 64):  # hardly any and many false hits
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        ids = spark.createDataFrame([(i,) for i in (2, 6, 105, 399, 7777, None, 105)], "doc_id long")
        got, want = without(docs, "doc_id", ids), docs.join(ids, "doc_id", "left_anti")
        assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, want.select(docs.columns).collect()))
    assert without(docs, "doc_id", ids.limit(0)).count() == docs.count() and without(docs.limit(0), "doc_id", ids).count() == 0


def test_spread_join_is_an_inner_join(spark):
    rows = [(0, i) for i in range(3000)] + [(i % 700, i) for i in range(3000, 6000)] + [(None, 1), (10_000, 2)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(i, i * i) for i in range(600)], "k long, w long")
    for some in (left, left.limit(5), left.where("false")):
        want = sorted(tuple(r) for r in some.join(right, "k").select("k", "v", "w").collect())
        assert sorted(tuple(r) for r in spread_join(some, right, "k").select("k", "v", "w").collect()) == want

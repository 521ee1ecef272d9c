import os
import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import sharding as s

from .common import odd, table


def noise(n, seed):
    return random.Random(seed).randbytes(n).hex()


@pytest.fixture
def store(spark, tmp_path):
    return s.Store(spark, f"file://{tmp_path}/store", s.Settings(target_bytes=120_000, smallest_bytes=4_000))


def rows_of(df):
    return sorted(map(str, df.collect()))


def part(spark, start, n, size=2000):
    return spark.createDataFrame([(i, noise(size, i)) for i in range(start, start + n)], "doc_id long, text string").coalesce(1)


def test_appends_are_small_and_merges_reach_the_target(spark, store):
    everything = None
    for k in range(12):
        new = part(spark, 100 * k, 4 + k % 3)
        everything = new if everything is None else everything.union(new)
        store.append(new)
    before = store.manifest().collect()
    assert len(before) == 12 and all(r["bytes"] < 30_000 for r in before)
    store.compact("doc_id")
    after = store.manifest().collect()
    assert rows_of(store.read()) == rows_of(everything)
    assert sum(r["rows"] for r in after) == everything.count() and len(after) < 5
    assert all(r["bytes"] < 1.6 * 120_000 for r in after)
    tiers = [r["tier"] for r in after if 2 * r["bytes"] <= 120_000]
    assert all(tiers.count(t) < 4 for t in tiers)
    for f in after:
        ids = [r["doc_id"] for r in spark.read.parquet(f["path"]).collect()]
        assert ids == sorted(ids)


def test_only_similar_sizes_merge(spark, store):
    store.append(part(spark, 0, 20))
    big = store.manifest().first()["path"]
    for k in range(4):
        store.append(part(spark, 1000 + 10 * k, 2))
    store.compact("doc_id")
    assert big in {r["path"] for r in store.manifest().collect()} and store.manifest().count() == 2
    assert store.compact("doc_id") == store.versions()[-1]  # nothing more to do


def test_readers_keep_their_version_and_writers_conflict(spark, store):
    store.append(part(spark, 0, 2))
    old = store.versions()[-1]
    store.append(part(spark, 10, 2))
    assert store.read(old).count() == 2 and store.read().count() == 4
    with pytest.raises(s.Conflict):
        store.commit(store.manifest(old), old)
    assert store.read().count() == 4 and store.versions() == [1, 2]


def test_an_uncommitted_run_is_invisible_and_vacuumed(spark, store, tmp_path):
    store.append(part(spark, 0, 2))
    part(spark, 50, 2).write.parquet(f"{store.root}/data/crashed")
    assert store.read().count() == 2
    for k in range(5):
        store.append(part(spark, 100 + 10 * k, 2))
    store.compact("doc_id")
    store.vacuum()
    assert store.read().count() == 12 and os.path.exists(f"{tmp_path}/store/data/crashed")  # its writer may still commit
    store.vacuum(older_than_s=0)
    assert store.read().count() == 12 and len(store.versions()) == 1
    left = [f for d, _, names in os.walk(f"{tmp_path}/store/data") for f in names if f.endswith(".parquet")]
    assert len(left) == store.manifest().count()


def plan_by_hand(shards, target, fanout):
    """{path: run} by a plain loop over the tiers."""
    out = {}
    for tier in {t for *_, t in shards}:
        mine = sorted((b, n, p) for n, p, b, t in shards if t == tier and 2 * b <= target)
        if len(mine) < fanout:
            continue
        total = sum(b for b, *_ in mine)
        runs, before, placed = max(1, int(total / target + 0.5)), 0, {}
        for b, _, p in mine:
            placed.setdefault(min(before * runs // total, runs - 1), []).append(p)
            before += b
        out |= {p: (tier, r) for r, ps in placed.items() if len(ps) > 1 for p in ps}
    return out


def test_the_plan_matches_a_plain_loop(spark, store):
    for seed in range(4):
        r = random.Random(seed)
        shards = [(f"n{i:03d}", f"p{i}", r.choice([500, 900, 3_000, 9_000, 20_000, 59_000, 61_000, 130_000]) + r.randrange(50)) for i in range(r.randrange(3, 60))]
        rows = spark.createDataFrame([(n, p, 1, b) for n, p, b in shards], "shard string, path string, rows long, bytes long").withColumn("tier", store._tier(F.col("bytes")))
        tiers = {x["path"]: x["tier"] for x in rows.collect()}
        got = {x["path"]: divmod(x["run"], 1 << 32) for x in store.plan(rows).collect()}
        assert got == plan_by_hand([(n, p, b, tiers[p]) for n, p, b in shards], store.settings.target_bytes, store.settings.fanout)


def test_each_run_has_a_task_of_its_own(spark, store):
    for n in (1, 2, 7, 40):
        keys = store._deals(n).select("lodestack_deal").repartition(n, "lodestack_deal").select(F.spark_partition_id().alias("p")).collect()
        assert sorted(r["p"] for r in keys) == list(range(n))


def test_names_are_stable_and_rounds_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "MOST_PATHS", 9)
    names = []
    for k in range(2):
        store = s.Store(spark, f"file://{tmp_path}/store{k}", s.Settings(target_bytes=60_000, smallest_bytes=4_000))
        for i in range(30):
            store.append(part(spark, 10 * i, 4))
        before = store.versions()[-1]
        store.compact("doc_id")
        assert store.versions()[-1] - before > 3 and store.read().count() == 120 and store.read().select("doc_id").distinct().count() == 120
        names.append({(r["shard"], r["rows"]) for r in store.manifest().collect()})
    assert names[0] == names[1] and len({n for n, _ in names[0]}) == len(names[0]) > 3


def test_odd_rows_and_empty_tables(spark):
    docs = table(spark, odd()).repartition(7)
    out = s.shard(docs, settings=s.Settings(target_bytes=200_000, smallest_bytes=2_000))
    assert out.columns == [*docs.columns, "shard", "shard_rows", "shard_bytes", "version"]
    assert rows_of(out.select(docs.columns)) == rows_of(docs)
    assert out.groupBy("shard", "shard_rows").count().where("count <> shard_rows").count() == 0
    clash = s.shard(docs.withColumn("shard", F.lit(1)).withColumn("Version", F.lit(2)))
    assert clash.columns[-4:] == ["shard_", "shard_rows", "shard_bytes", "version_"] and clash.where("shard = 1").count() == len(odd())
    none = s.shard(docs.limit(0))
    assert none.count() == 0 and none.columns == out.columns

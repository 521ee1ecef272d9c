import os

import corpus_pipeline as p
from lodestack.llm import common, decontaminate, mixing, ngram_join, quality
from lodestack.llm.common import read_table

from ..conftest import SF
from .common import odd, table, words

real = common.scratch_path


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"] and p.ORACLE_SQL is None


def test_each_stage_decides_on_what_the_last_kept(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    labels, bench = read_table(spark, SF, "labels"), read_table(spark, SF, "benchmark")
    steps = [docs]
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(i)))
        steps.append(spark.read.parquet(str(tmp_path / str(i))))
        assert steps[-1].columns[: len(docs.columns)] == docs.columns
    judged, single, clean, mixed, shards = steps[1:]
    assert ids(judged) == ids(quality.classify(docs, labels).where("predicted = 1"))
    groups = ngram_join.join(judged, ngram_join.Settings(words=5, percent=80))
    assert ids(single) == ids(groups.where("doc_id = component_id")) and single.count() < judged.count()
    gone = {r[0] for r in decontaminate.contaminated(single, bench).select("doc_id").collect()}
    assert gone and ids(clean) == [i for i in ids(single) if i not in gone]
    assert ids(mixed) == sorted(i for r in mixing.mix(clean).collect() for i in [r["doc_id"]] * r["copies"])
    assert sorted(map(str, shards.select(docs.columns).collect())) == sorted(map(str, mixed.collect()))
    assert shards.groupBy("shard", "shard_rows").count().where("count <> shard_rows").count() == 0


def test_run_gives_the_last_stage(spark):
    out = p.run(spark, SF)
    assert out.count() > 0 and "shard" in out.columns


def test_odd_rows_and_empty_tables(spark):
    rows = odd(2000) + [(100 + i, f"this is a plain text number {i} of the and to in it with words", "en", "a") for i in range(30)]
    for docs in (table(spark, rows), table(spark, [])):
        for _, stage in p.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns
            out.count()
    one = p.keep_one_of_each(spark, table(spark, rows[:15]), SF)
    assert sorted(str(r["doc_id"]) for r in one.collect()).count("6") == 1 and "7" not in {str(r["doc_id"]) for r in one.collect()}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    item = read_table(spark, SF, "benchmark").where("length(text) > 60").orderBy("item_id").first()["text"]
    clean = [" ".join(f"plain{i}x{j}" for j in range(40)) for i in range(4)]
    rows = [(None, t, "en", "a") for t in (*clean, clean[0], item, f"{clean[3]} {item}")] + [(7, clean[1], "en", "a"), (8, item, "en", "a")]
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    left = p.drop_benchmark(spark, table(spark, rows), SF)
    assert texts(left) == sorted([("None", t) for t in (*clean, clean[0])] + [("7", clean[1])])
    single = p.keep_one_of_each(spark, left, SF)
    assert texts(single) == sorted([("None", clean[i]) for i in (0, 2, 3)] + [("7", clean[1])])
    assert single.schema == left.schema


def test_a_stage_leaves_only_what_its_result_reads(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common, "scratch_path", lambda s, name: made.append((name, path := real(s, name))) or path)
    rows = table(spark, [(i, words(60, i % 40), "en", "a") for i in range(80)])
    left = p.keep_one_of_each(spark, rows, SF)
    here = [name for name, path in made if os.path.exists(path.removeprefix("file://"))]
    assert ids(left) == list(range(40)) and sorted(here) == ["bits", "components", "twice"] and len(made) > 10

import numpy as np
import pytest

from lodestack.functions.hashing import node_key_of, splitmix_of
from lodestack.operators import graph
from lodestack.operators.graph import FastRP
from lodestack.plans import registry

from .conftest import SF


def test_node_keys_and_projection_are_pinned():
    assert node_key_of("a", "1") == 0xC13CD84A6BC18181 and node_key_of("r", "25802761") == 0x389AF9597E6BF572
    keys = np.array([node_key_of("a", str(i)) for i in range(4000)], np.uint64)
    r = graph.projection(keys, 8, FastRP().seed)
    assert set(np.unique(r)) == {np.float32(-np.sqrt(3)), np.float32(0), np.float32(np.sqrt(3))}
    assert abs((r != 0).mean() - 1 / 3) < 0.01 and abs(r.mean()) < 0.03
    assert (graph.projection(keys[:7], 8, FastRP().seed) == r[:7]).all()  # a row depends on its own key alone
    assert 0 <= splitmix_of(1) < 1 << 64


def bag(spark, pairs):
    return spark.createDataFrame([("x", a, b) for a, b in pairs], "relation string, src string, dst string")


def test_edges_collapse_and_loops_go(spark):
    both = graph.undirected(bag(spark, [("r:1", "a:1"), ("r:1", "a:1"), ("a:1", "r:1"), ("a:1", "a:1"), ("r:1", "a:2")]))
    assert {tuple(r) for r in both.collect()} == {("r:1", "a:1"), ("a:1", "r:1"), ("r:1", "a:2"), ("a:2", "r:1")}
    assert {tuple(r) for r in graph.degrees(both).collect()} == {("r:1", 2), ("a:1", 1), ("a:2", 1)}
    assert {r["weight"] for r in graph.transitions(both).where("src = 'r:1'").collect()} == {0.5}


def test_credits_drop_and_fan_out(spark):
    credits = spark.createDataFrame([("Bass", 1, "session", 1), ("Design", 1, "design", 1), ("Unknown", 1, "engineering", 1), ("Two", 1, "production", 1), ("Two", 1, "production", 2), ("Liaison", 2, "other", 1)], "person_name string, release_id long, role_category string, track int")
    same = spark.createDataFrame([("Bass", 7), ("Design", 8), ("Two", 9), ("Two", 10), ("Liaison", 11)], "person_name string, artist_id long")
    assert sorted(tuple(r) for r in graph.credited_artists(credits, same).collect()) == [(1, 7), (1, 9), (1, 10), (2, 11)]
    assert {r[0] for r in graph.discovered_releases(credits).collect()} == {1, 2}


def dense(pairs, config):
    names = sorted({x for p in pairs for x in p})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in pairs:
        if a != b:
            m[at[a], at[b]] = m[at[b], at[a]] = 1
    d = m.sum(1)
    p = np.divide(m, d[:, None], out=np.zeros_like(m), where=d[:, None] > 0)
    keys = np.array([node_key_of(*n.split(":", 1)) for n in names], np.uint64)
    now = graph.projection(keys, config.dim, config.seed).astype(np.float64) * np.maximum(d, 1)[:, None] ** config.beta

    def unit(x):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    total = config.self_weight * unit(now)
    for w in config.weights:
        now = p @ now
        total = total + w * unit(now)
    return names, total


@pytest.mark.parametrize(("config", "block"), [(FastRP(dim=16), 10**6), (FastRP(dim=40), 37), (FastRP(dim=8, self_weight=0, beta=-0.5, weights=(1, 0, 0.5)), 90)])
def test_fastrp_matches_dense_matrices(spark, config, block):
    rng = np.random.default_rng(11)
    pairs = [(f"r:{i}", f"a:{int(rng.zipf(1.6)) % 40}") for i in range(150) for _ in range(2)] + [(f"r:{i}", f"g:{i % 3}") for i in range(150)] + [("a:99", "a:99")]
    names, want = dense(pairs, config)
    got = {r["vertex"]: r["embedding"] for r in graph.fastrp(bag(spark, pairs), config, block_edges=block).collect()}
    for n, w in zip(names, want, strict=True):
        assert np.abs(np.array(got.get(n, np.zeros(config.dim))) - w).max() < 1e-5, n
    kept = graph.fastrp(bag(spark, pairs), config, ("g",))
    assert {r["vertex"] for r in kept.collect()} == {"g:0", "g:1", "g:2"}


def test_version_names_every_parameter():
    assert FastRP().model_version == "fastrp-v2:dim=128:weights=0,1,1,1,1:beta=0:self=0.05:proj=achlioptas-s3:rows=splitmix64(blake2b64(kind,key)):seed=20260924"
    with pytest.raises(ValueError):
        FastRP(weights=(0.0, 0.0))


def test_vertex_sample_is_of_the_least_mixed_keys(spark):
    points = graph.keyed(spark.createDataFrame([(f"a:{i}",) for i in range(200)], "vertex string"))
    want = sorted((splitmix_of(node_key_of("a", str(i)) ^ 5), f"a:{i}") for i in range(200))[:17]
    assert {r["vertex"] for r in graph.vertex_sample(points.repartition(3), 17, 5).collect()} == {v for _, v in want}


def test_equal_keys_are_refused(spark):
    with pytest.raises(ValueError, match="a:1 and a:2"):
        graph.with_distinct_keys(spark.createDataFrame([("a:1", 5), ("a:2", 5), ("a:3", 6)], "vertex string, node_key long"))


def test_relations_of_dumps_become_edges(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "by_artist": table([("1", "7")], "release_id string, artist_id string"),
        "track_credited_on": table([("Bob", "1", "engineering"), ("Bob", "1", "design"), ("Eve", "2", "session"), ("No one", "3", "session")], "person_name string, release_id string, role_category string"),
        "track_by_artist": table([("1", 0, "9")], "release_id string, track_ordinal int, artist_id string"),
        "master_in_style": table([("4", "Dub")], "master_id string, style string"),
    }
    same = table([("Bob", "8"), ("Eve", "10"), ("Eve", "11")], "person_name string, artist_id string")
    got = {tuple(r) for r in graph.edges_of(tables, same).collect()}
    assert got == {("by_artist", "r:1", "a:7"), ("track_credited_on", "r:1", "a:8"), ("track_credited_on", "r:2", "a:10"), ("track_credited_on", "r:2", "a:11"), ("track_by_artist", "r:1", "a:9"), ("master_in_style", "m:4", "s:Dub")}


@pytest.fixture
def shared_names(spark):
    """Tables in which names share artists, artists have several names, and the same edge comes by several relations."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    credits = [(name, release, kind) for release in range(1, 9) for name, kind in (("A", "session"), ("B", "design"), ("BCD"[release % 3], "production"), ("A", "other"))]
    tables = {
        "by_artist": table([(1, 10), (1, 10), (2, 99), (3, 12), (9, 99), (None, 1), (4, None)], "release_id long, artist_id long"),
        "in_genre": table([(1, "x"), (1, "x"), (2, "y")], "release_id long, genre string"),
        "master_by_artist": table([(1, 10), (5, 14)], "master_id long, artist_id long"),
        "credited_on": table([*credits, ("Z", 7, "other"), (None, 7, "other"), ("A", None, "other")], "person_name string, release_id long, role_category string"),
        "track_credited_on": table([("D", 20, "engineering"), ("A", 1, "session")], "person_name string, release_id long, role_category string"),
        "track_by_artist": table([(1, 0, 10), (20, 1, 13), (20, 2, 77)], "release_id long, track_ordinal int, artist_id long"),
    }
    same = table([("A", 10), ("A", 11), ("B", 11), ("B", 12), ("C", 12), ("C", 11), ("D", 13), ("D", 14), ("D", 15)], "person_name string, artist_id long")
    return tables, same


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [500_000, 0])
def test_edges_to_groups_give_what_listed_edges_give(spark, shared_names, monkeypatch, small):
    monkeypatch.setattr(graph, "MOST_NAMES", small)
    tables, same = shared_names
    found, bag = graph.Relations(tables, same), graph.edges_of(tables, same)
    both = graph.undirected(bag)
    assert rows_of(found.report()) == rows_of(graph.edge_report(bag))
    assert rows_of(found.vertices()) == rows_of(graph.vertices(bag))
    known = spark.createDataFrame([("r:1",), ("r:500",)], "vertex string")
    assert rows_of(found.vertices(known)) == rows_of(graph.vertices(bag, known))
    assert rows_of(found.degrees()) == rows_of(graph.degrees(both))
    assert rows_of(found.transitions()) == rows_of(graph.transitions(both))
    pairs = rows_of(graph.credited_artists(tables["credited_on"].where("release_id IS NOT NULL"), same))
    wanted = {(r, a) for n, r, k in tables["credited_on"].collect() if k != "design" and r for m, a in same.collect() if m == n}
    assert pairs == sorted(wanted)
    assert found.credited["credited_on"].count() < len(pairs)


def test_listed_edges_are_not_shuffled(spark, capsys):
    registry.credited_artist_edges(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning(release_id" in plan and not any("Exchange" in line and "release_id" in line and "artist_id" in line for line in plan.splitlines())


@pytest.fixture
def crowded_names(spark):
    """Credits of 3,000 releases, and 64 names with 200 artists each."""
    credits = spark.range(12_000).selectExpr("concat('n', pmod(xxhash64(id), 64)) AS person_name", "id % 3000 AS release_id", "'session' AS role_category")
    return credits, spark.range(12_800).selectExpr("concat('n', id % 64) AS person_name", "id AS artist_id")


def bytes_of(path):
    return sum(p.stat().st_size for p in path.glob("*.parquet"))


@pytest.mark.parametrize("most", [1 << 15, 700])
def test_listed_edges_lie_by_group_and_take_little_room(spark, crowded_names, tmp_path, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_PAIRS", most)
    credits, same = crowded_names
    edges = graph.credited_artists(credits, same)
    edges.write.parquet(str(tmp_path / "edges"))
    found = spark.read.parquet(str(tmp_path / "edges"))
    wanted = credits.join(same, "person_name").select("release_id", "artist_id").distinct()
    assert found.count() == wanted.count() > 1_000_000 and found.exceptAll(wanted).count() == 0
    assert bytes_of(tmp_path / "edges") < 0.4 * found.count()


def test_transitions_of_listed_edges_take_little_room(spark, crowded_names, tmp_path):
    credits, same = crowded_names
    graph.Relations({"credited_on": credits}, same).transitions().write.parquet(str(tmp_path / "weights"))
    found = spark.read.parquet(str(tmp_path / "weights"))
    both = graph.undirected(graph.edges_of({"credited_on": credits}, same))
    wanted = graph.transitions(both)
    assert found.count() == wanted.count() > 2_000_000 and found.exceptAll(wanted).count() == 0
    assert bytes_of(tmp_path / "weights") < 0.6 * found.count()


@pytest.mark.parametrize(("config", "sizes"), [(FastRP(dim=16), {}), (FastRP(dim=40), {"PART_EDGES": 7, "RUN": 2, "SLICE": 3, "HELD_BYTES": 0, "ROWS": 4}), (FastRP(dim=8, self_weight=0, beta=-0.5, weights=(1, 0, 0.5)), {"SLICE": 1})])
def test_fastrp_by_columns_gives_what_listed_edges_give(spark, shared_names, monkeypatch, config, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(graph, name, value)
    tables, same = shared_names
    known = spark.createDataFrame([(1,), (500,)], "key long")
    pairs = [(r["src"], r["dst"]) for r in graph.edges_of(tables, same).collect()]
    names, want = dense(pairs, config)

    def embed(kinds=None, **more):
        return {r["vertex"]: np.array(r["embedding"]) for r in graph.fastrp_of(graph.Relations(tables, same), lambda: graph.edges_of(tables, same), config, kinds, {"r": known}, **more).collect()}

    got = embed()
    assert set(got) == {*names, "r:500"}
    for n, w in zip(names, want, strict=True):
        assert np.abs(got[n] - w).max() < 1e-5, n
    if not sizes:
        assert {v[0] for v in embed(("a",))} == {"a"}
        rest = embed(slice_bytes=1)  # too many vertices for a slice
        assert rest.keys() == got.keys() and max(np.abs(got[v] - rest[v]).max() for v in got) < 1e-5


def test_sums_of_packed_edges_are_those_of_listed_ones():
    rng = np.random.default_rng(5)
    src, dst = np.unique(np.minimum(rng.zipf(1.3, (4000, 2)), 300) - 1, axis=0).T
    x = rng.standard_normal((300, 5)).astype(np.float32)
    want, out = np.zeros((300, 5)), np.zeros((300, 5), np.float32)
    np.add.at(want, src, x[dst].astype(np.float64))
    way = graph._laid(src, dst)
    assert len(way["twice"])
    graph._add(out, x, *(np.frombuffer(way[c], np.int32) for c in graph._LAID))
    assert np.abs(out - want).max() < 1e-4


def test_embeddings_list_no_edges_to_credited_artists(spark, monkeypatch):
    monkeypatch.setattr(graph, "credited_artists", None)
    assert registry.fastrp_embeddings(spark, SF).count() == 10

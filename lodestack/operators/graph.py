"""The property graph: relations to undirected edges, credits resolved to artists, degrees, and FastRP embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.hashing import GAMMA, MASK, node_key, splitmix, splitmix_of
from lodestack.sources.storage import shared_dir

#: Credit categories that become edges; fixed values.
ROLES_KEPT = ("production", "engineering", "session", "other")
#: Kinds of vertices; fixed values.
KINDS = {"artist": "a", "release": "r", "label": "l", "master": "m", "genre": "g", "style": "s"}


def artist_groups(same_as: DataFrame) -> DataFrame:
    """(person_name, artist_id, group), written: artists with the same set of names are a group, named by its least artist. Groups are
    disjoint, so a release that names a group has an edge to each of its artists, and edges to groups count those without listing them."""
    names = same_as.where("person_name IS NOT NULL AND artist_id IS NOT NULL").groupBy("artist_id").agg(F.array_sort(F.collect_set("person_name")).alias("names"))
    lead = names.groupBy("names").agg(F.min("artist_id").alias("group"))
    return kept(names.join(lead, "names").select(F.explode("names").alias("person_name"), "artist_id", "group"), "groups")


#: Names and members of groups that are broadcast, at most.
MOST_NAMES = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_NAMES + 1).count() <= MOST_NAMES else df


def members_of(groups: DataFrame) -> DataFrame:
    """(group, artist_id), each artist once."""
    return groups.select("group", "artist_id").distinct()


def _named_groups(credits: DataFrame, groups: DataFrame) -> DataFrame:
    """(release_id, group), repeated: groups of artist_groups that a credit in a kept category names."""
    kept_ = credits.where(F.col("role_category").isin(*ROLES_KEPT)).select("person_name", "release_id")
    return kept_.join(_small(groups.select("person_name", "group").distinct()), "person_name").select("release_id", "group")


#: Artists of a list: what one run of Parquet's bit-packed values holds, so that a list that is repeated gives equal bytes.
LIST = 504
#: Pairs of a release and a group of a task that lists edges, and edges that it lists, at least and at most.
TASK_PAIRS, TASK_EDGES, MOST_TASK_EDGES = 1 << 15, 1 << 19, 1 << 25
#: Pairs that stand for fewer edges each than this are left as they lie.
LEAST_FAN_OUT = 4


def lists_of(members: DataFrame) -> DataFrame:
    """(group, list, artist_id): groups cut into lists of LIST artists, the rest into a multiple of 8 and fewer than 8; lists are named
    by their least artist."""
    group = Window.partitionBy("group")
    at, n = F.row_number().over(group.orderBy("artist_id")) - 1, F.count("*").over(group)
    piece = F.when(F.col("_at") < F.col("_n") - F.col("_n") % 8, F.floor(F.col("_at") / LIST)).otherwise(-1)
    cut = members.select("group", "artist_id", at.alias("_at"), n.alias("_n")).withColumn("_piece", piece)
    return cut.select("group", F.min("artist_id").over(Window.partitionBy("group", "_piece")).alias("list"), "artist_id")


def listed_together(pairs: DataFrame, listed: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """pairs(key, group, ...) with list for group, a row for each list of the group. Those of a list lie side by side, so the edges that
    they fan out to repeat the list, which Parquet stores in a tenth of the room, as long as a file's keys fit its dictionary of 1 MB:
    hence TASK_PAIRS. listed(group) tells how many pairs there are at most; a stored table."""
    heads = _small(lists.select("group", "list").distinct())
    sizes = _small(lists.groupBy("group").agg(F.count("*").alias("n")))
    rows, edges = listed.join(sizes, "group").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if edges < LEAST_FAN_OUT * max(rows, 1):
        return pairs.join(heads, "group").drop("group")
    tasks = max(1, min(-(-rows // TASK_PAIRS), -(-edges // TASK_EDGES)), edges // MOST_TASK_EDGES)
    laid = pairs.repartitionByRange(tasks, "group", key).join(heads, "group").drop("group").sortWithinPartitions("list", key)
    # A sort below a join is dropped as useless, unless something between them is not deterministic.
    return laid.withColumn("list", F.when(F.monotonically_increasing_id() >= 0, F.col("list")))


def credited_artists(credits: DataFrame, same_as: DataFrame) -> DataFrame:
    """(release_id, artist_id), distinct, of credits in a kept category: a name that stands for several artists gives an edge to each,
    one that stands for none gives none. Edges fan out last, from distinct edges to groups, so they are never shuffled."""
    groups = artist_groups(same_as)
    lists = kept(lists_of(members_of(groups)), "lists")
    named = kept(_named_groups(credits, groups), "named")
    pairs = listed_together(named.distinct(), named, lists, "release_id")
    return pairs.join(_small(lists.select("list", "artist_id")), "list").select("release_id", "artist_id")


def discovered_releases(credits: DataFrame) -> DataFrame:
    return credits.where(F.col("role_category").isin(*ROLES_KEPT)).select("release_id").distinct()


def relation_edges(rows: DataFrame, src: str, src_kind: str, dst: str, dst_kind: str, name: str) -> DataFrame:
    """(relation, src, dst) with vertices as kind:key."""
    end = lambda c, k: F.concat(F.lit(KINDS[k] + ":"), F.col(c).cast("string"))
    return rows.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.lit(name).alias("relation"), end(src, src_kind).alias("src"), end(dst, dst_kind).alias("dst"))


#: The relations of a catalogue: name, source column and kind, target column and kind. Those of names are resolved to artists first.
RELATIONS = (
    ("by_artist", "release_id", "release", "artist_id", "artist"),
    ("on_label", "release_id", "release", "label_id", "label"),
    ("derived_from", "release_id", "release", "master_id", "master"),
    ("in_genre", "release_id", "release", "genre", "genre"),
    ("in_style", "release_id", "release", "style", "style"),
    ("master_by_artist", "master_id", "master", "artist_id", "artist"),
    ("master_in_genre", "master_id", "master", "genre", "genre"),
    ("master_in_style", "master_id", "master", "style", "style"),
    ("credited_on", "release_id", "release", "artist_id", "artist"),
    ("track_credited_on", "release_id", "release", "artist_id", "artist"),
    ("track_by_artist", "release_id", "release", "artist_id", "artist"),
)


def edges_of(tables: dict[str, DataFrame], same_as: DataFrame) -> DataFrame:
    """All relations as one bag of (relation, src, dst), from their tables by name, such as those of dumps; absent ones are left
    out. Credits, on releases and on tracks, are of names; same_as(person_name, artist_id) resolves them."""
    found = {n: credited_artists(t, same_as) if n in ("credited_on", "track_credited_on") else t for n, t in tables.items()}
    return reduce(DataFrame.unionByName, [relation_edges(found[name], *ends, name) for name, *ends in RELATIONS if name in found])


def catalogue_edges(cat) -> DataFrame:
    return edges_of({name: getattr(cat, name) for name, *_ in RELATIONS}, cat.same_as)


def named_releases(cat) -> DataFrame:
    """(key): releases that a credit or a track names, even if none of its names is an artist's; repeated."""
    credits = [c.where(F.col("role_category").isin(*ROLES_KEPT)) for c in (cat.credited_on, cat.track_credited_on)]
    return reduce(DataFrame.union, [rows.select(F.col("release_id").alias("key")) for rows in (*credits, cat.track_by_artist)])


def catalogue_releases(cat) -> DataFrame:
    """(vertex): named_releases, once each."""
    return named_releases(cat).distinct().select(_vertex(KINDS["release"], "key").alias("vertex"))


class Relations:
    """The relations of a catalogue as distinct edges, in the tables' own types, with those to credited artists as edges to groups."""

    def __init__(self, tables: dict[str, DataFrame], same_as: DataFrame):
        self.groups = artist_groups(same_as)
        self.members = members_of(self.groups)
        self.plain: dict[str, tuple[str, str, DataFrame]] = {}
        self.credited: dict[str, DataFrame] = {}
        self.rows: dict[str, DataFrame] = {}  # of plain, as they come
        for name, src, src_kind, dst, dst_kind in RELATIONS:
            if name in ("credited_on", "track_credited_on") and name in tables:
                rows = _named_groups(tables[name].where(F.col(src).isNotNull()), self.groups).withColumnRenamed(src, "src")
                self.rows[name], self.credited[name] = rows, rows.distinct()
            elif name in tables:
                rows = tables[name].select(F.col(src).alias("src"), F.col(dst).alias("dst"))
                rows = rows.where("src IS NOT NULL AND dst IS NOT NULL")
                self.rows[name] = rows
                self.plain[name] = KINDS[src_kind], KINDS[dst_kind], rows.distinct()

    def report(self) -> DataFrame:
        """See edge_report; sources are counted with their edges, by one partial sum."""
        sizes = _small(self.members.groupBy("group").agg(F.count("*").alias("n")))
        found = []
        for name, (_, _, pairs) in self.plain.items():
            found.append((name, pairs.groupBy("src").agg(F.count("*").alias("n")), pairs.select("dst").distinct().agg(F.count("*").alias("targets"))))
        for name, pairs in self.credited.items():
            sized = pairs.join(sizes, "group")
            found.append((name, sized.groupBy("src").agg(F.sum("n").alias("n")), pairs.select("group").distinct().join(sizes, "group").agg(F.sum("n").alias("targets"))))
        rows = [
            near.agg(F.lit(name).alias("relation"), F.sum("n").alias("edges"), F.count("*").alias("sources")).where("sources > 0").crossJoin(F.broadcast(far))
            for name, near, far in found
        ]
        return reduce(DataFrame.unionByName, rows)

    def ends(self) -> dict[str, DataFrame]:
        """{kind: (key)} of all ends of edges, keys repeated; edges needn't be distinct for that, and aren't made so."""
        out: dict[str, list[DataFrame]] = {}
        for name, (src_kind, dst_kind, _) in self.plain.items():
            out.setdefault(src_kind, []).append(self.rows[name].select(F.col("src").alias("key")))
            out.setdefault(dst_kind, []).append(self.rows[name].select(F.col("dst").alias("key")))
        for name in self.credited:
            rows = self.rows[name]
            out.setdefault(KINDS["release"], []).append(rows.select(F.col("src").alias("key")))
            out.setdefault(KINDS["artist"], []).append(rows.select("group").distinct().join(self.members, "group").select(F.col("artist_id").alias("key")))
        return {kind: reduce(DataFrame.union, rows) for kind, rows in out.items()}

    def vertices(self, known: DataFrame | None = None, keys: dict[str, DataFrame] | None = None) -> DataFrame:
        """See vertices(); keys are known ones too, as (key) by kind."""
        ends = self.ends()
        for kind, rows in (keys or {}).items():
            ends[kind] = ends[kind].union(rows) if kind in ends else rows
        all_ = [rows.distinct().select(_vertex(kind, "key").alias("vertex"), F.lit(kind).alias("kind")) for kind, rows in ends.items()]
        if known is not None:
            all_.append(known.select("vertex", F.substring_index("vertex", ":", 1).alias("kind")))
        found = reduce(DataFrame.union, all_)
        return found if known is None else found.distinct()

    def merged(self) -> tuple[list[tuple[str, str, DataFrame]], DataFrame | None]:
        """Edges in one direction, parallel ones as one: by kinds of ends (src, dst), and (src, group) of credits. Edges from a release to
        an artist of a group that it names stand in the latter alone."""
        kinds: dict[tuple[str, str], list[DataFrame]] = {}
        for src_kind, dst_kind, pairs in self.plain.values():
            kinds.setdefault((src_kind, dst_kind), []).append(pairs)
        plain = {k: rows[0] if len(rows) == 1 else reduce(DataFrame.union, rows).distinct() for k, rows in kinds.items()}
        if not self.credited:
            return [(*k, rows) for k, rows in plain.items()], None
        named = reduce(DataFrame.unionByName, self.credited.values())
        named = named if len(self.credited) == 1 else named.distinct()
        own = KINDS["release"], KINDS["artist"]
        if own in plain:
            direct = plain[own].join(_small(self.members.withColumnRenamed("artist_id", "dst")), "dst", "left")
            plain[own] = direct.join(named, ["src", "group"], "left_anti").select("src", "dst")
        return [(*k, rows) for k, rows in plain.items()], named

    def degrees_by_kind(self) -> dict[str, DataFrame]:
        """{kind: (key, degree)}."""
        plain, named = self.merged()
        out: dict[str, list[DataFrame]] = {}
        for src_kind, dst_kind, pairs in plain:
            for kind, end in ((src_kind, "src"), (dst_kind, "dst")):
                out.setdefault(kind, []).append(pairs.groupBy(F.col(end).alias("key")).agg(F.count("*").alias("degree")))
        if named is not None:
            sizes = _small(self.members.groupBy("group").agg(F.count("*").alias("n")))
            out.setdefault(KINDS["release"], []).append(named.join(sizes, "group").groupBy(F.col("src").alias("key")).agg(F.sum("n").alias("degree")))
            times = named.groupBy("group").agg(F.count("*").alias("degree"))
            out.setdefault(KINDS["artist"], []).append(times.join(self.members, "group").select(F.col("artist_id").alias("key"), "degree"))
        return {kind: reduce(DataFrame.union, rows).groupBy("key").agg(F.sum("degree").alias("degree")) for kind, rows in out.items()}

    def degrees(self) -> DataFrame:
        """See degrees()."""
        return reduce(DataFrame.union, [rows.select(_vertex(kind, "key").alias("vertex"), "degree") for kind, rows in self.degrees_by_kind().items()])

    def transitions(self) -> DataFrame:
        """See transitions(); weights join the edges to groups and the groups' lists, which fan out last, and ends get their names before."""
        weight = {k: kept(rows.select("key", (1 / F.col("degree")).alias("weight")), "weights") for k, rows in self.degrees_by_kind().items()}
        of = lambda kind, end: weight[kind].select(F.col("key").alias(end), F.col("weight").alias(f"{end}_weight"))
        plain, named = self.merged()
        rows = []
        for src_kind, dst_kind, pairs in plain:
            both = pairs.join(of(src_kind, "src"), "src").join(of(dst_kind, "dst"), "dst")
            rows.append(_both_ways(both, src_kind, dst_kind))
        if named is not None:
            r, a = KINDS["release"], KINDS["artist"]
            lists = lists_of(self.members).withColumnRenamed("artist_id", "dst").join(of(a, "dst"), "dst")
            lists = kept(lists.select("group", "list", _vertex(a, "dst").alias("dst"), "dst_weight"), "lists")
            pairs = kept(named.join(of(r, "src"), "src").select("group", _vertex(r, "src").alias("src"), "src_weight"), "pairs")
            near = listed_together(pairs, pairs, lists, "src").join(_small(lists.drop("group")), "list")
            # A direction at a time: where both alternate, no value is repeated.
            rows.append(near.select("src", "dst", F.col("src_weight").alias("weight")))
            rows.append(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_weight").alias("weight")))
        return reduce(DataFrame.unionByName, rows)


def _vertex(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _both_ways(rows: DataFrame, src_kind: str, dst_kind: str) -> DataFrame:
    """(src, dst, weight) in both directions of rows(src, dst, src_weight, dst_weight)."""
    rows = rows.select(_vertex(src_kind, "src").alias("src"), _vertex(dst_kind, "dst").alias("dst"), "src_weight", "dst_weight")
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(f"{x}_weight").alias("weight"))
    return rows.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))


def lines_stored(cat):
    """The catalogue with lines joined with their parts once, not for each relation of tags or credits."""
    return cat.with_lines_stored(lambda df: kept(df, "lines"))


def relations_of(cat, stored: bool = False) -> Relations:
    """The relations of a catalogue; stored tells that it comes from lines_stored."""
    cat = cat if stored else lines_stored(cat)
    return Relations({name: getattr(cat, name) for name, *_ in RELATIONS}, cat.same_as)


def edge_report(edges: DataFrame) -> DataFrame:
    """(relation, edges, sources, targets): distinct edges and ends of each relation."""
    return edges.distinct().groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, parallel edges as one and loops gone. Ordered ends are made distinct first, so only half
    of the rows are shuffled; each is then read once and gives two rows."""
    one = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    return one.select(F.inline(F.array(ends("a", "b"), ends("b", "a"))))


def vertices(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(vertex, kind) of all ends, and of known(vertex) that have no edge."""
    ends = edges.select(F.col("src").alias("vertex")).union(edges.select(F.col("dst").alias("vertex")))
    ends = ends if known is None else ends.union(known.select("vertex"))
    return ends.distinct().select("vertex", F.substring_index("vertex", ":", 1).alias("kind"))


def degrees(both: DataFrame) -> DataFrame:
    """(vertex, degree) of undirected(): the number of distinct neighbours."""
    return both.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))


def transitions(both: DataFrame) -> DataFrame:
    """(src, dst, weight): the row-normalised matrix, 1 / degree of the source."""
    return both.join(degrees(both).withColumnRenamed("vertex", "src"), "src").select("src", "dst", (1 / F.col("degree")).alias("weight"))


@dataclass(frozen=True)
class FastRP:
    """Parameters; the defaults are fixed values of the production vectors."""

    dim: int = 128
    weights: tuple[float, ...] = (0.0, 1.0, 1.0, 1.0, 1.0)
    beta: float = 0.0
    self_weight: float = 0.05
    seed: int = 20260924

    def __post_init__(self):
        if self.dim < 1 or not any(self.weights):
            raise ValueError("a positive dim and a weight that isn't 0 are needed")

    @property
    def model_version(self) -> str:
        weights = ",".join(f"{w:g}" for w in self.weights)
        return f"fastrp-v2:dim={self.dim}:weights={weights}:beta={self.beta:g}:self={self.self_weight:g}:proj=achlioptas-s3:rows=splitmix64(blake2b64(kind,key)):seed={self.seed}"


def projection(keys: np.ndarray, dim: int, seed: int, first: int = 0) -> np.ndarray:
    """Rows of the sparse random matrix for node keys: minus or plus the root of 3 in a sixth of the places each, else 0; of columns
    from first up to dim."""
    out = np.zeros((len(keys), dim - first), np.float32)
    low, high = np.uint64((1 << 64) // 6), np.uint64((1 << 64) - (1 << 64) // 6)
    for j in range(first, dim):
        u = splitmix(keys ^ np.uint64(splitmix_of((seed + (j + 1) * GAMMA) & MASK)))
        out[u < low, j - first], out[u >= high, j - first] = -np.sqrt(3), np.sqrt(3)
    return out


def keyed(points: DataFrame) -> DataFrame:
    """(vertex, node_key); see with_distinct_keys."""
    return points.select("vertex", _key("vertex").alias("node_key"))


def _key(vertex: str):
    return node_key(F.substring_index(vertex, ":", 1), F.expr(f"substring({vertex}, instr({vertex}, ':') + 1)"))


def with_distinct_keys(points: DataFrame) -> DataFrame:
    """keyed(vertex, node_key) as it is; ValueError if two vertices have one key."""
    twice = points.groupBy("node_key").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).where("a <> b").take(1)
    if twice:
        raise ValueError(f"two vertices have one key: {twice[0]['a']} and {twice[0]['b']}")
    return points


def kept(df: DataFrame, name: str = "graph") -> DataFrame:
    """Written to the shared folder and read back: computed once, however often it is used, and a lost executor costs a step."""
    return df.sparkSession.read.parquet(_written(df, name))


def _written(df: DataFrame, name: str) -> str:
    """The URI of the folder that a table was written to."""
    path = f"{shared_dir(df.sparkSession)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; they travel as bytes, which are copied whole, not element by element."""
    if not len(column):
        return np.zeros((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, dim)


def _bytes(v: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((np.arange(len(v) + 1) * v.shape[1] * 4).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(v), [None, offsets, pa.py_buffer(np.ascontiguousarray(v, np.float32))])


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _unit(v: np.ndarray, weight) -> np.ndarray:
    """Rows at a length of weight; zero rows stay."""
    size = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    return v * np.divide(weight, size, out=np.zeros_like(size), where=size > 0)[:, None]


def _sums(v: np.ndarray, at: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of v that at names, from each start on; NumPy adds up one long run of rows fast, and many short ones at once."""
    out = np.zeros((len(start), v.shape[1]))
    for i in np.flatnonzero(n > FEW):
        run = at[start[i] : start[i] + n[i]]
        for a in range(0, len(run), GATHERED):
            out[i] += v.take(run[a : a + GATHERED], 0).sum(0, np.float64)
    few = np.flatnonzero(n <= FEW)
    for a in range(0, len(few), GATHERED // FEW):
        some = few[a : a + GATHERED // FEW]
        ends = np.cumsum(n[some])
        places = np.repeat(start[some] - ends + n[some], n[some]) + np.arange(ends[-1])
        out[some] = np.add.reduceat(v.take(at[places], 0), ends - n[some], 0, np.float64)
    return out


#: Edges of a block, about, and of the part of one source that lies in a block. A task holds a vector for each target of its block,
#: so at most 512 bytes for each of its edges; the fewer blocks, the less often a vector is shipped.
BLOCK_EDGES = 2_000_000
#: Vectors that are gathered at a time, and the edges up to which sources are added up together, not one by one.
GATHERED, FEW = 1 << 16, 32
#: Sources with so many edges that they are cut, at most, that are broadcast.
MOST_HUBS = 100_000


def blocks_of(both: DataFrame, block_edges: int = BLOCK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(block, src, dst) of undirected edges by key, and the sources (src) that are cut over several blocks: those of more than
    block_edges edges, by their targets."""
    edges = both.count()
    degree = both.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > block_edges)
    hubs = kept(degree.select("src", F.ceil(F.col("n") / block_edges).cast("int").alias("parts")))
    few = F.broadcast(hubs) if hubs.count() <= MOST_HUBS else hubs
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)))
    block = F.pmod(F.xxhash64("src", part), F.lit(max(1, -(-edges // block_edges)))).cast("int")
    return both.join(few, "src", "left").select(block.alias("block"), "src", "dst"), hubs.select("src")


def fastrp(edges: DataFrame, config: FastRP = FastRP(), kinds: tuple[str, ...] | None = None, known: DataFrame | None = None, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(vertex, embedding): sums of the normalised powers of the transition matrix times the projection, and of the normalised
    projection itself at self_weight. A vertex without neighbours, such as one of known(vertex), keeps what its own row gives;
    zero rows stay 0.

    Edges are dealt into blocks by source once. A hop ships each vector once to each block that has an edge to it, and a block
    takes the means of its sources by slices of columns; the parts of a cut source are put together afterwards. The projection is made
    from keys where it is needed and never shipped. Each hop is written to the shared folder, so a lost executor costs one hop."""
    dim = config.dim
    bag = kept(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    points = with_distinct_keys(kept(keyed(vertices(bag, known))))
    both = kept(undirected(bag.where("src <> dst").select(_key("src").alias("src"), _key("dst").alias("dst"))))
    dealt, hubs = blocks_of(both, block_edges)

    def pack(edges: pa.Table) -> pa.Table:
        """A block as one row: its targets, its sources, where the edges of each start, and the targets' places in their order."""
        src, dst = (edges.column(c).to_numpy() for c in ("src", "dst"))
        order = np.argsort(src, kind="stable")
        src, (dst, at) = src[order], np.unique(dst[order], return_inverse=True)
        start = _runs(src)
        bits = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        targets = pa.ListArray.from_arrays(pa.array([0, len(dst)], pa.int32()), pa.array(dst))
        return pa.table({"block": edges.column("block").slice(0, 1), "dst": targets, "src": bits(src[start], np.int64), "start": bits(start, np.int32), "at": bits(at, np.int32)})

    packed = kept(dealt.groupBy("block").applyInArrow(pack, "block int, dst array<long>, src binary, start binary, at binary"))
    need = packed.select(F.col("block").alias("to"), F.explode("dst").alias("dst"))
    if config.beta:
        degree = both.groupBy(F.col("src").alias("dst")).agg(F.pow(F.count("*"), F.lit(config.beta)).alias("scale"))
        scaled = kept(need.join(degree, "dst").select("to", "dst", "scale"))
    else:
        scaled = need.withColumn("scale", F.lit(1.0))

    def means(first: bool):
        def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
            src, start, at = (np.frombuffer(edges.column(c)[0].as_py(), kind) for c, kind in (("src", np.int64), ("start", np.int32), ("at", np.int32)))
            keys = vectors.column("dst").to_numpy()
            if first:
                v = projection(keys.view(np.uint64), dim, config.seed) * vectors.column("scale").to_numpy()[:, None].astype(np.float32)
            else:
                v = np.concatenate([_matrix(chunk, dim) for chunk in vectors.column("v").chunks])
            at = np.argsort(keys)[at]
            n = np.diff(np.r_[start, len(at)])
            out = _sums(v, at, start, n) / n[:, None]
            return pa.table({"key": pa.array(src, pa.int64()), "n": pa.array(n, pa.int64()), "v": _bytes(out)})

        return run

    def whole(key, parts):
        """The mean of a cut source from the means of its parts."""
        n = parts.column("n").to_numpy()
        v = _matrix(pa.concat_arrays(parts.column("v").chunks), dim).astype(np.float64)
        return pa.table({"key": parts.column("key").slice(0, 1), "n": pa.array([int(n.sum())], pa.int64()), "v": _bytes(((n / n.sum()) @ v)[None])})

    schema = "key long, n long, v binary"
    cut = hubs.take(1)
    now, terms = None, []
    last = max(k for k, w in enumerate(config.weights) if w)
    for k in range(last + 1):
        moved = scaled if now is None else need.join(now.select(F.col("key").alias("dst"), "v"), "dst")
        now = kept(packed.drop("dst").groupBy("block").cogroup(moved.groupBy("to")).applyInArrow(means(now is None), schema))
        if cut:
            split = F.broadcast(hubs) if hubs.count() <= MOST_HUBS else hubs
            parts = now.join(split, F.col("key") == F.col("src"), "left_semi").groupBy("key").applyInArrow(whole, schema)
            now = kept(now.join(split, F.col("key") == F.col("src"), "left_anti").unionByName(parts))
        if config.weights[k]:
            terms.append(now.select("key", F.lit(float(config.weights[k])).alias("w"), "v"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by key of rows in order of it, at their weights; a row without a vector stands for the projection of its key."""
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, w, none = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
            v = np.zeros((len(keys), dim))
            v[none] = projection(keys[none].view(np.uint64), dim, config.seed)
            v[~none] = _matrix(batch.column(2).filter(pa.array(~none)), dim)
            v = _unit(v, w)
            if held is not None:
                keys, v = np.r_[held[0], keys], np.concatenate([held[1], v])
            start = _runs(keys)
            keys, v = keys[start], np.add.reduceat(v, start, 0)
            held = keys[-1:], v[-1:]
            yield out(keys[:-1], v[:-1])
        if held is not None:
            yield out(*held)

    def out(keys: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel().astype(np.float32)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat], names=["node_key", "embedding"])

    mine = points if kinds is None else points.where(F.substring_index("vertex", ":", 1).isin(*kinds))
    mine = kept(mine.select("vertex", "node_key"))
    keys = mine.select(F.col("node_key").alias("key"))
    rows = reduce(DataFrame.unionByName, terms).join(keys, "key", "left_semi")
    rows = rows.unionByName(keys.select("key", F.lit(float(config.self_weight)).alias("w"), F.lit(None).cast("binary").alias("v")))
    total = rows.repartition("key").sortWithinPartitions("key").mapInArrow(added, "node_key long, embedding array<float>")
    return total.join(mine, "node_key").select("vertex", "embedding")


#: Edges of a packed part of the graph, about, and of the runs in which sums are added up, at most.
PART_EDGES, RUN = 2_000_000, 64
#: Bytes of a task's two slices of columns over all vertices, about, the columns of a slice and the bytes of the graph that a task holds, at most.
SLICE_BYTES, SLICE, HELD_BYTES = 384 << 20, 32, 192 << 20
#: Rows that are put together at a time.
ROWS = 4096


def _batches(uri: str, columns: list[str], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a written table in the order in which they were written, read on an executor, one file after the other."""
    files, base = fs.FileSystem.from_uri(uri)
    for path in sorted(f.path for f in files.get_file_info(fs.FileSelector(base)) if f.is_file and f.base_name.startswith("part-")):
        with files.open_input_file(path) as stream:
            yield from pq.ParquetFile(stream).iter_batches(size, columns=columns)


def _column(uri: str, name: str, kind) -> np.ndarray:
    """A whole column of a written table; nulls are 0."""
    return np.concatenate([np.zeros(0, kind), *(b.column(0).fill_null(0 if kind != bool else False).to_numpy(zero_copy_only=False) for b in _batches(uri, [name]))])


def _laid(src: np.ndarray, dst: np.ndarray) -> dict[str, bytes]:
    """Edges in an order in which sums by source are sums of whole arrays: the edges of each source are runs of RUN at most, longest
    first, and at holds the first target of all runs, then the second of those that have two, and so on. wide tells how many runs
    those are, src their sources; the runs of sources that have several follow each other in twice."""
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    start = _runs(src)
    n = np.diff(np.r_[start, len(src)])
    pieces = -(-n // RUN)
    of = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, size = start[of] + nth * RUN, np.minimum(n[of] - nth * RUN, RUN)
    by = np.argsort(-size, kind="stable")
    begin, size, of = begin[by], size[by], of[by]
    wide = [int(np.searchsorted(-size, -k)) for k in range(size[0])]
    at = np.concatenate([dst[begin[:m] + k] for k, m in enumerate(wide)])
    several = np.flatnonzero(pieces[of] > 1)
    several = several[np.argsort(of[several], kind="stable")]
    return {"src": src[start][of].astype(np.int32).tobytes(), "wide": np.array(wide, np.int32).tobytes(), "at": at.astype(np.int32).tobytes(), "twice": several.astype(np.int32).tobytes()}


_LAID = ("src", "wide", "at", "twice")


def _add(out: np.ndarray, x: np.ndarray, src: np.ndarray, wide: np.ndarray, at: np.ndarray, twice: np.ndarray) -> None:
    """Adds to the rows of out that are sources the sums of the rows of x that are their targets; see _laid."""
    found, a = x.take(at[: wide[0]], 0), wide[0]
    for m in wide[1:]:
        found[:m] += x.take(at[a : a + m], 0)
        a += m
    if len(twice):
        start = _runs(src[twice])
        out[src[twice][start]] += np.add.reduceat(found[twice], start, 0, np.float64).astype(out.dtype)
        once = np.ones(len(src), bool)
        once[twice] = False
        src, found = src[once], found[once]
    found += out.take(src, 0)
    row = f"V{out.shape[1] * out.itemsize}"  # rows are copied whole, not element by element
    out.view(row)[src, 0] = found.view(row)[:, 0]


def fastrp_of(found: Relations, listed: Callable[[], DataFrame], config: FastRP = FastRP(), kinds: tuple[str, ...] | None = None, known: dict[str, DataFrame] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """fastrp() of listed(), the edges that found stands for, without listing them: a group's artists are added up once for all
    releases that name it, and its releases once for all its artists, so the work grows with distinct edges to groups. known
    has (key) of vertices by kind.

    The columns of the projection move through the graph apart from each other. So a task takes all hops of a slice of columns, over
    all vertices, and reads the packed graph once a hop; vectors are shipped only at the end, those that are asked for. Graphs of
    so many vertices that one column of them is more than slice_bytes go through fastrp()."""
    spark, dim = found.members.sparkSession, config.dim
    points = with_distinct_keys(kept(keyed(found.vertices(keys=known))))
    asked = F.lit(True) if kinds is None else F.substring_index("vertex", ":", 1).isin(*kinds)
    place = lambda vertex: F.xxhash64(vertex)
    group = place(F.concat(F.lit("=:"), F.col("group").cast("string")))
    rows = points.select(place(F.col("vertex")).alias("id"), "node_key", asked.alias("asked"))
    placed = _written(rows.union(found.members.select(group, F.lit(None).cast("long"), F.lit(False)).distinct()).orderBy("id"), "places")
    count = spark.read.parquet(placed).count()
    if count * 8 > slice_bytes:
        return fastrp(listed(), config, kinds, points.select("vertex"))

    edges = []
    for name, src, src_kind, dst, dst_kind in RELATIONS:
        if name in found.rows:
            end = group if name in found.credited else place(_vertex(KINDS[dst_kind], "dst"))
            edges.append(found.rows[name].select(place(_vertex(KINDS[src_kind], "src")).alias("a"), end.alias("b")))
    members = found.members.select(place(_vertex(KINDS["artist"], "artist_id")).alias("a"), group.alias("b"))
    listing = _written(members, "members")

    def pack(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Edges in order of a as parts, one a row, both ways, by the places of their ends: distinct ones, without those from a release
            to an artist of a group that it names. Of members, those that are no vertices are left out; edges have none of these."""
            ids = _column(placed, "id", np.int64)
            if (ids[1:] <= ids[:-1]).any():
                raise ValueError("two vertices have one place")

            def places(x: np.ndarray) -> np.ndarray:
                at = np.searchsorted(ids, x)
                at[ids.take(at, mode="clip") != x] = -1
                return at

            of = np.full(len(ids), -1)  # the group of each artist
            artist, named = (places(_column(listing, c, np.int64)) for c in ("a", "b"))
            of[artist[artist >= 0]] = named[artist >= 0]

            def part(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
                x, y = places(a), places(b)
                if whole and ((x < 0) | (y < 0)).any():
                    raise ValueError("an end of an edge is no vertex")
                both = np.unique((x << 32 | y)[(x >= 0) & (y >= 0)])
                if whole:
                    through = np.where(of[both & 0xFFFFFFFF] >= 0, both >> 32 << 32 | of[both & 0xFFFFFFFF], -1)
                    both = both[both.take(np.searchsorted(both, through), mode="clip") != through]
                x, y = both >> 32, both & 0xFFFFFFFF
                ways = (_laid(x, y), _laid(y, x)) if len(x) else ()
                cells = {f"{c}{i}": [way[c]] for i, way in enumerate(ways) for c in _LAID}
                return pa.RecordBatch.from_pydict(cells or {f.name: [] for f in target}, target)

            held, n = [], 0
            for batch in batches:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
                if n >= PART_EDGES:
                    a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                    cut = _runs(a)[-1]  # the edges of the last a may go on
                    if cut:
                        yield part(a[:cut], b[:cut])
                    held, n = [[a[cut:], b[cut:]]], len(a) - cut
            if n:
                yield part(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))

        target = pa.schema([(f"{c}{i}", pa.binary()) for i in (0, 1) for c in _LAID])
        return run

    schema = ", ".join(f"{c}{i} binary" for i in (0, 1) for c in _LAID)
    dealt = reduce(DataFrame.union, edges).repartition("a").sortWithinPartitions("a")
    parts = _written(dealt.mapInArrow(pack(True), schema), "parts")
    belongs = _written(spark.read.parquet(listing).mapInArrow(pack(False), schema), "parts")

    cores = spark.sparkContext.defaultParallelism
    tasks = -(-dim // min(SLICE, slice_bytes // (8 * count)))
    width = -(-dim // min(dim, -(-tasks // cores) * cores))
    last = max(k for k, w in enumerate(config.weights) if w)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth in batch.column(0).to_pylist():
                yield from moved(nth * width, min(dim, (nth + 1) * width))

    def moved(lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """Columns lo to hi of the asked rows' powers: (chunk, lo, keys, v), v by power, row and column."""

        stock: dict[str, list[list[np.ndarray]]] = {}

        def laid(uri: str) -> Iterator[list[np.ndarray]]:
            """Each part of a packed table, one way after the other; a table of HELD_BYTES at most is read once."""
            if uri in stock:
                yield from stock[uri]
                return
            keep, size = [], 0
            for row in _batches(uri, [f"{c}{i}" for i in (0, 1) for c in _LAID], 1):
                for i in (0, 1):
                    way = [np.frombuffer(row.column(f"{c}{i}")[0].as_py(), np.int32) for c in _LAID]
                    size += sum(x.nbytes for x in way)
                    keep = [*keep, way] if size <= HELD_BYTES else []
                    yield way
            if size <= HELD_BYTES:
                stock[uri] = keep

        def spread(x: np.ndarray) -> np.ndarray:
            """The sums of each vertex's neighbours; x is 0 at groups, and so is the result."""
            for nth, way in enumerate(laid(belongs)):
                if nth % 2:
                    _add(x, x, *way)
            out = np.zeros_like(x)
            for way in laid(parts):
                _add(out, x, *way)
            for nth, way in enumerate(laid(belongs)):
                if not nth % 2:
                    _add(out, out, *way)
            out[groups] = 0
            return out

        keys = _column(placed, "node_key", np.int64).view(np.uint64)
        groups = np.concatenate([np.zeros(0, bool), *(b.column(0).is_null().to_numpy(zero_copy_only=False) for b in _batches(placed, ["node_key"]))])
        rows = np.flatnonzero(_column(placed, "asked", bool))
        degree = np.ones((len(keys), 1))
        degree[groups] = 0
        degree = np.maximum(spread(degree), 1)
        now = np.empty((len(keys), hi - lo), np.float32)
        for a in range(0, len(keys), GATHERED):
            now[a : a + GATHERED] = projection(keys[a : a + GATHERED], hi, config.seed, lo)
            if config.beta:
                now[a : a + GATHERED] *= degree[a : a + GATHERED] ** config.beta
        now[groups] = 0
        keys, degree = keys[rows], degree.astype(np.float32)
        terms = []
        for k in range(last + 1):
            now = spread(now)
            now /= degree
            if config.weights[k]:
                terms.append(now[rows])
        for a in range(0, len(rows), ROWS):
            v = np.stack([t[a : a + ROWS] for t in terms])
            yield pa.RecordBatch.from_pydict({"chunk": [a // ROWS], "lo": [lo], "keys": [keys[a : a + ROWS].tobytes()], "v": [v.tobytes()]}, slices)

    slices = pa.schema([("chunk", pa.int32()), ("lo", pa.int32()), ("keys", pa.binary()), ("v", pa.binary())])
    weights = [w for w in config.weights if w]

    def whole(chunk: pa.Table) -> pa.Table:
        """The slices of some rows put together, normalised and added up at their weights."""
        chunk = chunk.sort_by("lo")
        keys = np.frombuffer(chunk.column("keys")[0].as_py(), np.uint64)
        v = np.concatenate([np.frombuffer(x.as_py(), np.float32).reshape(len(weights), len(keys), -1) for x in chunk.column("v")], 2)
        out = sum((_unit(t, w) for t, w in zip(v, weights, strict=True)), _unit(projection(keys, dim, config.seed), config.self_weight))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * dim, pa.int32()), pa.array(out.ravel().astype(np.float32)))
        return pa.table({"node_key": pa.array(keys.view(np.int64)), "embedding": flat})

    tasks = -(-dim // width)
    columns = kept(spark.range(0, tasks, 1, tasks).mapInArrow(move, "chunk int, lo int, keys binary, v binary"), "columns")
    total = columns.groupBy("chunk").applyInArrow(whole, "node_key long, embedding array<float>")
    return total.join(points.where(asked), "node_key").select("vertex", "embedding")


def vertex_sample(points: DataFrame, n: int, seed: int) -> DataFrame:
    """The n vertices of keyed(vertex, node_key) whose keys mixed with a seed are least, unsigned: the same for any order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = splitmix(batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(seed))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((mixed ^ np.uint64(1 << 63)).view(np.int64))], names=["vertex", "node_key", "place"])

    return points.select("vertex", "node_key").mapInArrow(run, "vertex string, node_key long, place long").orderBy("place").limit(n).drop("place")

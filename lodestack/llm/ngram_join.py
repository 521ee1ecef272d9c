"""N-gram Jaccard join: signature trees over documents that share a segment of their sets.

1. Each text becomes its set of word shingles (64-bit hashes); equal sets are one class with its least id.
2. Sets of a Jaccard similarity of t differ in at most d = a + b - 2 * ceil(t / (1 + t) * (a + b)) shingles. The range of the
   hashes is cut into m segments, m by the size's octave; a set gives the content of its first d + 1 segments of at least two
   shingles as keys. d differences spoil d segments at most, so two sets that link share a key. A key is several shingles at
   once, so a passage that many documents share, or a frequent line, brings few others together. Sets too small for enough such
   segments also give their first shingles, rarest first as far as a sample tells, and meet each other there.
3. Classes that share a key meet in its signature tree. A node holds the OR of bitmaps of its members' least shingles, their
   range of sizes and, if uniform, their component; a traversal of pairs of nodes prunes by size, by component and by the
   largest overlap that the bitmaps leave possible.
4. The sets of pairs that are left are compared exactly, and links are closed to components.

A group of thousands of near copies has millions of pairs that may link, whether they do or not. So before 3, classes whose
least telling shingle under one of a few mixes is the same in a crowd go through that crowd's signature tree with their sets: all its
pairs are decided there, and only links that join components come out. Trees of keys then skip pairs of one crowd."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import bounded_broadcast, discard, release, spread_join, stored
from lodestack.llm.components import connected_components


#: Bits of the narrowest bitmaps, and of those in inner nodes.
LOW = 1024


@dataclass(frozen=True)
class Settings:
    words: int = 4
    percent: int = 85  # link if 100 * intersection >= percent * union
    sample: int = 4096  # documents whose shingles tell which are common; only the order, so only speed, depends on it
    common: float = 0.002  # share of the sample from which a shingle is common
    crowd: int = 32  # classes with one least shingle from which on they are a crowd
    tile: int = 512  # classes of a crowd that meet in one task; a larger crowd is cut into tiles, and each pair of tiles is a task
    tile_shingles: int = 1 << 20  # shingles of a tile, about, which bounds the memory of a task
    tile_key: int = 2048  # classes with one key that meet in one task; more are cut into tiles too
    mixes: tuple[int, ...] = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def first(self, n: int) -> int:
        """Of so many first shingles, in any one order, a set of n shares one with each set that it links with."""
        return n - -(-self.percent * n // 100) + 1

    def shown(self, n: int) -> int:
        """How many least shingles of a set of n its bitmap shows: all of a small set."""
        return min(n, max(self.first(n), LOW // 2))

    def apart(self, n: int) -> int:
        """In how many shingles a set of n and a set that it links with differ at most."""
        most = 100 * n // self.percent
        return max(n + b - 2 * self.needed(n, b) for b in {most, max(n, most - 1), max(n, most - 2), n, max(1, n - 1)} if self.needed(n, b) <= min(n, b))

    def segments(self, octave: int) -> int:
        """Segments for sizes below 2 ** (octave + 1); enough that most of a set's have two shingles or more, and that more of
        them do than differ."""
        return max(1, int((2 << octave) * (100 - self.percent) / self.percent / 0.8))

    def enough(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def needed(self, a: int, b: int) -> int:
        """The least intersection of sets of these sizes that links them."""
        return -(-self.percent * (a + b) // (100 + self.percent))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of word shingles as sorted arrays of 64-bit hashes; remembers the hashes of words."""

    def __init__(self, words: int):
        self.words, self.known = words, _Hashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        tokens = (text or b"").lower().split()  # bytes: A-Z only, and cuts at space, tab, LF, VT, FF, CR
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(tokens) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), len(tokens))], np.uint64)
        known = self.known
        if len(known) > 100_000:
            known.clear()
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        n = len(h) - self.words + 1
        v = np.zeros(n, np.uint64)
        for i in range(self.words):
            v = (v ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(v ^ (v >> np.uint64(32)))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.array([xxhash.xxh3_64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])


def width_of(first: int) -> int:
    """Bits of a bitmap of so many shingles."""
    width = LOW
    while width < first * 2 and width < 16384:
        width *= 2
    return width


def bitmap(shingles: np.ndarray) -> bytes:
    width = width_of(len(shingles))
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits & ((1 << width) - 1)) | (bits >> width)
    return bits


class Order:
    """The common order of shingles: by hash, but common ones last, the most common at the end."""

    def __init__(self, common: list[tuple[int, int]]):
        ranked = sorted(common)
        self.hashes = np.array([h for h, _ in ranked], np.int64).view(np.uint64)
        order = np.argsort(self.hashes)
        self.hashes, self.counts = self.hashes[order], np.array([c for _, c in ranked], np.int64)[order]

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles are common, and where they stand among the common ones, of which there are some."""
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return self.hashes[at] == shingles, at

    def telling(self, shingles: np.ndarray) -> np.ndarray:
        """The shingles that may name a crowd: all of a set that is mostly common ones, such as a copy of a text with many copies;
        else the rare ones, since a passage that a share of all documents have would make a crowd of them, which grows with the input
        and whose pairs grow with its square."""
        if not len(self.hashes):
            return shingles
        common, _ = self.of(shingles)
        return shingles if 2 * np.count_nonzero(common) > len(shingles) else shingles[~common]

    def first(self, shingles: np.ndarray, k: int) -> np.ndarray:
        if not len(self.hashes):
            return shingles[:k]
        common, at = self.of(shingles)
        rare = shingles[~common]
        if len(rare) >= k:
            return rare[:k]
        rest = shingles[common]
        return np.concatenate([rare, rest[np.argsort(self.counts[at[common]], kind="stable")]])[:k]


@dataclass(slots=True)
class Member:
    cid: int
    part: int
    n: int
    bits: int
    width: int
    low: int  # the bitmap at LOW bits
    rest: int  # shingles that the low bitmap can't witness
    crowds: tuple = ()
    shingles: frozenset = frozenset()

    @classmethod
    def of(cls, cid: int, part: int, n: int, sig: bytes, *more) -> Member:
        width, bits = 8 * len(sig), int.from_bytes(sig, "little")
        low = folded(bits, width, LOW)
        return cls(cid, part, n, bits, width, low, n - low.bit_count(), *more)

    def met(self, other: Member) -> bool:
        """Whether a crowd has decided this pair."""
        return any(c in other.crowds for c in self.crowds)


def possible(a: Member, b: Member, settings: Settings) -> bool:
    """Whether a and b may link. Of two bitmaps, the one whose least shingles end at the smaller hash shows, with each bit that the
    other lacks, a shingle that the other set lacks."""
    need = settings.needed(a.n, b.n)
    if need > min(a.n, b.n):
        return False
    if max(a.rest, b.rest) + (a.low & b.low).bit_count() < need:
        return False
    if a.width == b.width == LOW:
        return True
    width = min(a.width, b.width)
    x, y = folded(a.bits, a.width, width), folded(b.bits, b.width, width)
    return max(a.n - x.bit_count(), b.n - y.bit_count()) + (x & y).bit_count() >= need


@dataclass(slots=True)
class Node:
    """OR of the bitmaps below, their size range, the largest rest, and the component if all have one."""

    below: list = field(default_factory=list)
    low: int = 0
    least: int = 1 << 60
    most: int = 0
    rest: int = 0
    part: int | None = None
    mixed: bool = False

    def add(self, x) -> None:
        self.below.append(x)
        self.low |= x.low
        least, most = (x.n, x.n) if isinstance(x, Member) else (x.least, x.most)
        self.least, self.most, self.rest = min(self.least, least), max(self.most, most), max(self.rest, x.rest)
        other = x.part is None or (not isinstance(x, Member) and x.mixed) or (self.part is not None and self.part != x.part)
        self.mixed = self.mixed or other
        self.part = x.part if self.part is None else self.part

    def apart(self, other: Node, settings: Settings) -> bool:
        """Whether no pair of the two nodes is worth a look."""
        if not self.mixed and not other.mixed and self.part == other.part:
            return True
        need = settings.needed(self.least, other.least)
        if need > min(self.most, other.most):
            return True
        return max(self.rest, other.rest) + (self.low & other.low).bit_count() < need


LEAF, FAN = 16, 8


def tree_pairs(members: Iterator[Member], settings: Settings) -> Iterator[tuple[Member, Member]]:
    """Pairs of different components that may link, of members in order of size. Leaves of LEAF members hang from nodes of FAN
    leaves; each full leaf is traversed against the tree so far, whose nodes go once they are too small for all that follows, so
    a task holds the members of one range of sizes."""
    roots: list[Node] = []
    leaf = Node()

    def meet(new: Node) -> Iterator[tuple[Member, Member]]:
        roots[:] = [r for r in roots if 100 * r.most >= settings.percent * new.least]
        for root in roots:
            if root.apart(new, settings):
                continue
            for old in root.below:
                if not old.apart(new, settings):
                    yield from ((a, b) for a in old.below for b in new.below if a.part != b.part and not a.met(b) and possible(a, b, settings))
        mine = new.below
        if new.mixed:
            yield from ((a, b) for i, a in enumerate(mine) for b in mine[i + 1 :] if a.part != b.part and not a.met(b) and possible(a, b, settings))
        if not roots or len(roots[-1].below) == FAN:
            roots.append(Node())
        roots[-1].add(new)

    for m in members:
        leaf.add(m)
        if len(leaf.below) == LEAF:
            yield from meet(leaf)
            leaf = Node()
    if leaf.below:
        yield from meet(leaf)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def common_shingles(docs: DataFrame, settings: Settings) -> list[tuple[int, int]]:
    """(hash, documents) of the shingles that are common in a sample; at most sample sizes / common of them."""
    total = docs.count()
    share = min(1.0, settings.sample / max(1, total))
    picked = _texts(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.words)
        for batch in batches:
            sets = [shingler(t) for t in batch.column(1).to_pylist()]
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = picked.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(8, int(settings.common * min(total, settings.sample)))
    return [(r["h"], r["n"]) for r in counts.where(F.col("n") >= least).collect()]


#: Smaller sets always give first shingles, too.
SMALL = 64


def keys_of(shingles: np.ndarray, order: Order, settings: Settings) -> np.ndarray:
    """The keys of a set: see the module's notes, step 2."""
    n = len(shingles)
    octave = n.bit_length() - 1
    wanted = settings.apart(n) + 1
    # A partner of the next octave uses its segments, so a set that may have one gives keys of both.
    octaves = [octave] + [octave + 1] * (100 * n >= settings.percent * (2 << octave))
    mixed = (shingles ^ (shingles >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    out, enough = [], n >= SMALL
    high = shingles >> np.uint64(32)
    for o in octaves:
        segment = (high * np.uint64(settings.segments(o))) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        several = np.diff(np.r_[start, n]) > 1
        content = np.add.reduceat(mixed, start) + (segment[start] * np.uint64(64) + np.uint64(o)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(content[several])
        enough = enough and len(out[-1]) >= wanted
    if enough:
        return np.concatenate([x[:wanted] for x in out])
    # All segments meet any partner that has enough of them; first shingles meet the others that don't.
    return np.concatenate([*out, order.first(shingles, settings.first(n)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)])


def describe(docs: DataFrame, order, settings: Settings) -> DataFrame:
    """(doc_id, cid, n, sig, keys, least) of every row: the set's name and size, the bitmap of its least shingles, its keys, and
    its least shingle under each mix. Texts are read and cut into words once; all that follows works on this table."""
    mixes = np.array(settings.mixes, np.uint64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.words)
        for batch in batches:
            cid, n, sig, keys, least = [], [], [], [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                n.append(len(s))
                if len(s):
                    cid.append(set_id(s))
                    sig.append(bitmap(s[: settings.shown(len(s))]))
                    keys.append(keys_of(s, order.value, settings).view(np.int64))
                    s = order.value.telling(s)
                    least.append((((s ^ (s >> np.uint64(31))) * mixes).min(1) >> np.uint64(1)).view(np.int64))
                else:
                    for column in (cid, sig, keys, least):
                        column.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, longs), pa.array(least, longs)],
                names=["doc_id", "cid", "n", "sig", "keys", "least"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, cid long, n long, sig binary, keys array<long>, least array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """(token, cid): keys that several classes have, with those classes; rows(cid, keys)."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order, those of tokens with two classes or more, each once. The last row of a batch waits for the next."""
        last, went = None, False  # the row that waits, and whether it is out already
        for batch in batches:
            token, cid = (c.to_numpy() for c in batch.columns)
            if last is not None:
                token, cid = np.concatenate([[last[0]], token]), np.concatenate([[last[1]], cid])
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
            token, cid = token[new], cid[new]
            same = token[1:] == token[:-1]
            out = np.zeros(len(token), bool)
            out[1:] |= same
            out[:-1] |= same
            had, last = went, (token[-1], cid[-1])
            went = bool(out[-1]) or (had and len(token) == 1)
            out[0] &= not had
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(cid[out])], names=["token", "cid"])

    tokens = rows.select(F.explode("keys").alias("token"), "cid")
    return tokens.repartition("token").sortWithinPartitions("token", "cid").mapInArrow(several, "token long, cid long")


def crowds_of(classes: DataFrame, settings: Settings) -> DataFrame:
    """(cid, crowd, tiles): the classes of each crowd, and into how many tiles it is cut."""
    keys = classes.select("cid", "n", F.posexplode("least").alias("mix", "key"))
    sizes = keys.groupBy("mix", "key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where(F.col("size") >= settings.crowd)
    tiles = F.ceil(F.greatest(F.col("size") / settings.tile, F.least(F.col("shingles") / settings.tile_shingles, F.col("size") / 2)))
    return keys.join(sizes, ["mix", "key"]).select("cid", F.xxhash64("mix", "key").alias("crowd"), tiles.cast("int").alias("tiles"))


def tile_pairs(rows: DataFrame) -> DataFrame:
    """rows(cid, tiles, ...) once for each pair (lo, hi) of tiles of its group that holds its own tile."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("other", "tiles")


def crowd_links(members: DataFrame, docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links that join the components of each crowd, or of two of its tiles; members of crowds_of."""
    if not members.take(1):
        return members.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    wanted = members.select("cid").distinct().join(classes.select("cid", "rep", "n"), "cid")
    wanted = stored(wanted, "wanted")
    texts = fetch(docs, wanted).join(classes.select("cid", "n"), "cid")
    rows = tile_pairs(members).join(texts, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.words)

        def flow():
            for batch in batches:
                yield from zip(*batch.columns, strict=True)

        rows = flow()
        head = next(rows, None)
        place = lambda r: tuple(r[i].as_py() for i in range(3))

        def group(here):
            """The members of a group. Shingles that no other member has can't be in an intersection, so only the others are kept
            as a set; before that a member is eight bytes for each shingle."""
            nonlocal head
            found = []
            while head is not None and place(head) == here:
                tile, cid, text = (head[i].as_py() for i in (3, 5, 6))
                s = shingler(text)
                # A document whose id several texts have may come with another text; the name tells.
                if len(s) and set_id(s) == cid:
                    found.append((cid, tile, s))
                head = next(rows, None)
            if len(found) < 2:
                return
            known, times = np.unique(np.concatenate([s for _, _, s in found]), return_counts=True)
            known = known[times > 1]
            for cid, tile, s in found:
                common = s[known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s] if len(known) else s[:0]
                # Pairs of one tile are decided in the tile's own task; elsewhere they count as one component.
                yield Member.of(cid, cid if here[1] == here[2] else tile, len(s), bitmap(s[: settings.shown(len(s))]), (), frozenset(common.tolist()))

        while head is not None:
            here, up, out = place(head), {}, []

            def root(x, up=up):
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            for a, b in tree_pairs(group(here), settings):
                x, y = root(a.cid), root(b.cid)
                if x != y and settings.enough(len(a.shingles & b.shingles), a.n, b.n):
                    up[max(x, y)] = min(x, y)
                    out.append((a.cid, b.cid))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    rows = rows.select("crowd", "lo", "hi", "tile", "n", "cid", "text").repartition("crowd", "lo", "hi")
    links = stored(rows.sortWithinPartitions("crowd", "lo", "hi", "n", "cid").mapInArrow(run, "a long, b long").distinct(), "links")
    discard(wanted)
    release(docs.sparkSession)
    return links


def candidate_pairs(shared: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """(a, b) that survive the signature trees; shared(token, cid), a written table; classes(cid, part, n, sig, crowds)."""
    sizes = shared.groupBy("token").agg(F.ceil(F.count("*") / settings.tile_key).cast("int").alias("tiles")).where("tiles > 1")
    sizes = bounded_broadcast(stored(sizes, "tiles"), MOST_BROADCAST)
    dealt = tile_pairs(shared.join(sizes, "token", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))))
    rows = dealt.join(classes, "cid").select("token", "lo", "hi", "n", "cid", "part", "sig", "crowds", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()

        def flow():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        rows = flow()
        head = next(rows, None)

        def group(here, tiles):
            nonlocal head
            while head is not None and head[:3] == here:
                tiles[head[4]] = head[8]
                yield Member.of(head[4], head[5], head[3], head[6], tuple(head[7] or ()))
                head = next(rows, None)

        def out():
            ends = list(zip(*met, strict=True)) if met else [(), ()]
            table = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])
            met.clear()
            return table

        while head is not None:
            here, tiles = head[:3], {}
            for a, b in tree_pairs(group(here, tiles), settings):
                if here[1] == here[2] or tiles[a.cid] != tiles[b.cid]:  # pairs of one tile come from the tile's own task
                    met.add((min(a.cid, b.cid), max(a.cid, b.cid)))
            if len(met) > 50_000:
                yield out()
        yield out()

    return rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "cid").mapInArrow(run, "a long, b long").distinct()


#: Keys of so many classes that they are cut, at most, that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Bits of the filter by which texts are fetched; false hits are removed by the join behind it.
FILTER_BITS = 1 << 24


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) for wanted(cid, rep): texts of the representatives. A bitmap of fixed size over hashed ids passes the few
    documents that are needed, so the other texts aren't shuffled; an exact join follows."""
    place = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    words = wanted.select(place.cast("int").alias("at")).selectExpr("shiftright(at, 5) AS w", "shiftleft(1L, at & 31) AS b")
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        table[r["w"]] = r["b"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit.astype(bool))) for c in batch.columns[:2]], names=["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _texts(docs).where("doc_id IS NOT NULL").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    rows = rows.mapInArrow(run, f"doc_id {kind}, text binary")
    return wanted.join(rows, F.col("rep") == F.col("doc_id")).select("cid", "text")


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose sets link, compared exactly; classes(cid, rep)."""
    pairs = stored(pairs, "pairs")
    release(docs.sparkSession)
    if not pairs.take(1):
        return pairs
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = stored(ends.join(classes.select("cid", "rep"), "cid"), "wanted")
    texts = stored(fetch(docs, wanted), "texts")
    of = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.words)
        last, left = None, None
        for batch in batches:
            (a, b), (text_a, text_b) = (c.to_pylist() for c in batch.columns[:2]), batch.columns[2:]
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, left = a[i], shingler(text_a[i].as_py())
                right = shingler(text_b[i].as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                # A document whose id several texts have may come with another text; the names tell.
                keep.append(settings.enough(both, len(left), len(right)) and set_id(left) == a[i] and set_id(right) == b[i])
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(keep, pa.bool_())) for j in (0, 1)], names=["a", "b"])

    links = stored(both.mapInArrow(run, "a long, b long").distinct(), "links")
    for used in (pairs, wanted, texts):
        discard(used)
    return links


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the least id with an equal set) for every row of docs(doc_id, text).

    A document's set: its distinct shingles of `words` words, A-Z in lower case; of fewer words, the sequence as one. Two
    documents link if 100 * intersection >= percent * union; component_id is the least doc_id that links reach. Every link
    between different sets is found or implied: pairs are skipped only if they can't link or are connected already.

    Null and empty texts have an empty set, are linked with nothing and are their own component. Rows of one id are one node
    of the graph, which joins the links of their texts; repeated rows get equal values. A null id names no node: such a row
    has the component of rows with an equal set and an id, else null. An empty table gives no rows; other columns are
    ignored. Sets and classes are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(Order(common_shingles(docs, settings)))
    rows = stored(describe(docs, order, settings), "sets")
    some = rows.where("n > 0")
    classes = some.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.first("least").alias("least"))
    classes = stored(classes, "classes")
    named = classes.where("rep IS NOT NULL")
    crowds = stored(crowds_of(named, settings), "crowds")
    early = crowd_links(crowds, docs, named, settings)
    parts = connected_components(early.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labelled = named.join(parts, F.col("cid") == F.col("node"), "left").join(crowds.groupBy("cid").agg(F.collect_set("crowd").alias("crowds")), "cid", "left")
    labelled = labelled.select("cid", "rep", "n", "sig", F.coalesce("component", "cid").alias("part"), "crowds")
    labelled = stored(labelled, "labelled")
    shared = stored(shared_keys(some), "shared")
    release(spark)
    late = linked(candidate_pairs(shared, labelled.drop("rep"), settings), docs, named, settings)
    for used in (shared, labelled):
        discard(used)
    release(spark)
    edges = spread_join(early.union(late), named.select(F.col("cid").alias("a"), F.col("rep").alias("src")), "a")
    edges = spread_join(stored(edges.select("src", "b"), "ends"), named.select(F.col("cid").alias("b"), F.col("rep").alias("dst")), "b").select("src", "dst")
    # Rows of one id with different texts are one node: their classes are linked through the id.
    ids = some.where("doc_id IS NOT NULL").join(named.select("cid", "rep"), "cid").where("doc_id <> rep")
    twice = some.groupBy("doc_id").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x <> y AND doc_id IS NOT NULL").select("doc_id")
    edges = edges.union(ids.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")))
    closed = connected_components(edges)
    found = named.select("cid", "rep").join(closed, F.col("rep") == F.col("node"), "left").select("cid", "rep", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "cid").join(found, "cid", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
    )

"""LM scoring: context-tree weighting over bytes, each byte decomposed into eight binary decisions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import fold, stored

#: Bytes of the longest context.
DEPTH = 5
#: The costs of the most frequent grams, at most so many, are looked up on the spot; those of all others are joined.
MOST_HOT = 1 << 20
#: Grams that a task weighs, about; the grams behind one pair of latest bytes stay together.
TASK_GRAMS = 100_000
#: A word is looked up on the spot if it has at least this share of all tokens, so at most 1 / share are broadcast; the
#: counts of all others are joined.
WORD_SHARE = 1 / 500_000
END = b"\n"  # ends a text; no word holds it
CHUNK = 1 << 20
MOST_TALLY = 200_000


def canonical(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case (bytes.split cuts at exactly space, tab, LF, VT, FF and CR)."""
    return (text or b"").lower().split()


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes): each text behind DEPTH ends, so that its first bytes have a context of ends alone."""
    pad = END * DEPTH
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]) + DEPTH
    return data, starts, sizes


def _codes(data: np.ndarray) -> np.ndarray:
    """The gram at each byte of a stream from DEPTH on: its context and the byte, as an integer with the latest byte lowest."""
    code = np.zeros(len(data) - DEPTH, np.int64)
    for i in range(DEPTH + 1):
        code = (code << 8) | data[i : len(data) - DEPTH + i]
    return code


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a context and the byte after it, and their counts."""
    data, starts, _ = _stream(texts)
    code = _codes(data)
    real = np.ones(len(code), bool)
    for s in starts[1:]:
        real[s - 2 * DEPTH : s - DEPTH] = False
    return np.unique(code[real], return_counts=True)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


COUNTS = "word binary, gram long, n long"


def count(texts: DataFrame) -> DataFrame:
    """(word, gram, n) over texts(text, held_out): counts of words, the empty word standing for the end of a text, and of byte
    grams (the other of the two columns is null). Held-out texts add no words, and their grams with a count of 0: the grams
    whose costs are asked for. Tasks count their own rows; a shuffle adds the partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held: dict[bool, list[bytes]] = {False: [], True: []}
        size = 0

        def take():
            parts.extend((g, n * (not out)) for out in held if held[out] for g, n in [_grams(held[out])])
            held.update({False: [], True: []})

        def words():
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.nulls(len(tally), pa.int64()), pa.array(list(tally.values()), pa.int64())], names=["word", "gram", "n"])
            tally.clear()

        def grams(least: int):
            if parts and (least == 0 or sum(len(p[0]) for p in parts) > least):
                merged = _merge(parts)
                parts[:] = [merged]
                if least == 0 or len(merged[0]) > least:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(merged[0]), pa.binary()), pa.array(merged[0]), pa.array(merged[1])], names=["word", "gram", "n"])
                    parts.clear()

        for batch in batches:
            for text, out in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tokens = canonical(text.as_py())
                if not out:
                    tally.update(tokens)
                    tally[b""] += 1
                held[out].append(b" ".join(tokens) + END)
                size += len(held[out][-1])
                if size > CHUNK:
                    take()
                    size = 0
                    yield from grams(1_000_000)
                if len(tally) > MOST_TALLY:
                    yield from words()
        take()
        yield from grams(0)
        yield from words()

    parts = texts.select(F.col("text").cast("binary").alias("text"), "held_out").mapInArrow(run, COUNTS)
    return parts.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260)) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 1.1447298858494002 - _log_gamma(zeros + ones + 1.0)


@dataclass
class _Nodes:
    """The bit nodes of one depth and one number of decided bits: key = context * 256 + those bits behind a leading one."""

    key: np.ndarray
    estimate: np.ndarray  # of a one
    stop: np.ndarray  # posterior weight of the node's own estimate against its children's
    weight: np.ndarray  # ln of the weighted probability of what the node saw
    seen: np.ndarray  # whether it saw anything; a node that is only asked for weighs nothing


def _nodes(grams: list[tuple[np.ndarray, np.ndarray]], j: int) -> list[_Nodes]:
    """For each depth, from grams[depth] = (context, latest byte highest, and the byte after it; count)."""
    raw = []
    for code, n in grams:
        byte = code & 255
        key, at = np.unique((code >> 8) * 256 + ((1 << j) | (byte >> (8 - j))), return_inverse=True)
        ones = np.bincount(at, np.where((byte >> (7 - j)) & 1, n, 0), len(key))
        raw.append((key, np.bincount(at, n, len(key)) - ones, ones))
    out: list[_Nodes] = []
    for d in range(len(raw) - 1, -1, -1):
        key, zeros, ones = raw[d]
        own = _log_kt(zeros, ones)
        if not out:
            both, stop = own, np.ones(len(key))
        else:
            below = raw[d + 1][0]
            parent = ((below >> 16) << 8) | (below & 255)
            inner = np.bincount(np.searchsorted(key, parent), weighted, len(key))
            both = np.logaddexp(own, inner) - np.log(2)
            stop = np.exp(own - np.log(2) - both)
        weighted = both
        out.append(_Nodes(key, ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32), stop.astype(np.float32), both, zeros + ones > 0))
    return out[::-1]


@dataclass
class Model:
    """symbol: byte to column; step[d]: row and the byte d + 1 back to the row of the longer context, if known;
    cost[row, column]: log10 of the column's byte after the row's context. width counts a last column for unseen bytes."""

    symbol: np.ndarray
    width: int
    step: list[np.ndarray]
    cost: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability."""
        data, starts, sizes = _stream(texts)
        s = self.symbol[data].astype(np.int32)
        n = len(s) - DEPTH
        row = np.zeros(n, np.int32)
        for d, step in enumerate(self.step):
            row = step.ravel()[row * self.width + s[DEPTH - 1 - d : DEPTH - 1 - d + n]]
        value = self.cost.ravel()[row.astype(np.int64) * self.width + s[DEPTH:]]
        sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        return sums[starts - DEPTH + sizes] - sums[starts - DEPTH]


def _turn(code: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Grams with their contexts' bytes in reverse."""
    turned = np.zeros(len(code), np.int64)
    for i in range(1, depth + 1):
        turned = (turned << 8) | ((code >> 8 * i) & 255)
    return (turned << 8) | (code & 255)


def _latest_first(code: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    turned = _turn(code, depth)
    order = np.argsort(turned)
    return turned[order], n[order]


def fit(grams: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The frozen predictor of gram counts by depth in one memory; the grams of a depth extend grams of the depth below.
    costs() gives the same probabilities on the cluster.

    Each bit node of each context has a Krichevsky-Trofimov estimate; going from the empty context to the longest, a node's
    own estimate gets the share `stop` of the weight that is left, its posterior against all deeper trees; the deepest
    context that saw the node gets the rest. Bytes that never occurred share the probability that is left evenly."""
    if not len(grams[0][0]):
        grams = [(np.array([int.from_bytes(END * (d + 1), "big")], np.int64), np.array([1], np.int64)) for d in range(DEPTH + 1)]
    grams = [_latest_first(code, n, d) for d, (code, n) in enumerate(grams)]
    nodes = [_nodes(grams, j) for j in range(8)]
    seen = np.union1d(np.unique(grams[0][0] & 255), [END[0]])
    width = len(seen) + 1
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    kept = [np.zeros(1, np.int64)]
    for d in range(1, DEPTH + 1):
        kept.append(np.unique(grams[d][0] >> 8))
    first = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64)
    parents = [np.searchsorted(kept[d - 1], kept[d] >> 8) for d in range(1, DEPTH + 1)]
    step = []
    for d in range(DEPTH):
        table = np.repeat(np.arange(first[d + 1], dtype=np.int32)[:, None], width, 1)
        table[parents[d] + first[d], symbol[kept[d + 1] & 255]] = np.arange(len(kept[d + 1])) + first[d + 1]
        table[:, -1] = np.arange(first[d + 1])
        step.append(table)
    cost = np.zeros((int(first[-1]), width), np.float32)

    def fill(d: int, lo: int, hi: int, above: list[np.ndarray], parent: np.ndarray) -> list[np.ndarray]:
        """Costs of the contexts lo to hi of a depth, a few at a time; weight spent so far, weight left, and the
        probability of a one if this depth is the last that saw a node, of each context and node."""
        below = []
        for a in range(lo, hi, 4096):
            mine = kept[d][a : min(hi, a + 4096)]
            q, r, p = (x[parent[a - lo : a - lo + len(mine)]] for x in above)
            for j in range(8):
                known = nodes[j][d]
                x, y = np.searchsorted(known.key, [mine[0] * 256, mine[-1] * 256 + 256])
                at = np.minimum(np.searchsorted(mine, known.key[x:y] >> 8), len(mine) - 1)
                hit = mine[at] == known.key[x:y] >> 8
                i, b, e, w = at[hit], known.key[x:y][hit] & 255, known.estimate[x:y][hit], known.stop[x:y][hit]
                p[i, b] = q[i, b] + r[i, b] * e
                q[i, b] += r[i, b] * w * e
                r[i, b] *= 1 - w
            chance = np.ones((len(mine), len(seen)))
            for j in range(8):
                ones = p[:, (1 << j) | (seen >> (8 - j))]
                chance *= np.where((seen >> (7 - j)) & 1, ones, 1 - ones)
            rest = np.maximum(1 - chance.sum(1), 1e-12) / max(1, 256 - len(seen))
            cost[first[d] + a : first[d] + a + len(mine)] = np.log10(np.column_stack([np.maximum(chance, 1e-30), rest]))
            below.append([q, r, p])
        return [np.concatenate(x) for x in zip(*below, strict=True)]

    root = fill(0, 0, 1, [np.full((1, 256), x, np.float32) for x in (0.0, 1.0, 0.5)], np.zeros(1, np.int64))
    for c in kept[1]:  # the contexts behind one latest byte lie together at every depth
        above, lo = root, 0
        for d in range(1, DEPTH + 1):
            a, b = np.searchsorted(kept[d], [c << 8 * (d - 1), (c + 1) << 8 * (d - 1)])
            if a == b:
                break
            above, lo = fill(d, a, b, above, parents[d - 1][a:b] - lo), a
    return Model(symbol, width, step, cost)


@dataclass
class _Top:
    """What depths 0 and 1 leave to the contexts below, by latest byte * 256 + decided bits behind a leading one: weight
    spent, weight left and the probability of a one if no longer context saw the node; known: bytes that occurred, and END."""

    spent: np.ndarray
    left: np.ndarray
    now: np.ndarray
    known: np.ndarray


def _deeper(state: list[np.ndarray], estimate: np.ndarray, stop: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    q, r, p = state
    return [np.where(seen, q + r * stop * estimate, q), np.where(seen, r * (1 - stop), r), np.where(seen, q + r * estimate, p)]


def _top(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray) -> _Top:
    """From the counts of depth 1's nodes and the sums of their children's weights."""
    zeros, ones, inner = (np.bincount(key, x, 1 << 16).reshape(256, 256) for x in (zeros, ones, inner))
    state = [np.full((256, 256), x) for x in (0.0, 1.0, 0.5)]
    levels = []
    for _ in range(2):
        own = _log_kt(zeros, ones)
        both = np.logaddexp(own, inner) - np.log(2)
        levels.append(((ones + 0.5) / (zeros + ones + 1), np.exp(own - np.log(2) - both), zeros + ones > 0))
        zeros, ones, inner = (x.sum(0) for x in (zeros, ones, both))
        if len(levels) == 1:
            last = np.column_stack([zeros[128:], ones[128:]]).ravel() > 0
    for level in levels[::-1]:
        state = _deeper(state, *level)
    last[END[0]] = True
    return _Top(*[x.ravel() for x in state], last)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams with the latest byte first, n) in order, cut between pairs of latest bytes into parts of about TASK_GRAMS."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    code, n = _latest_first(*(np.concatenate(x) for x in zip(*held, strict=True)), DEPTH)
    ends = np.flatnonzero(np.diff(code >> 32, append=-1)) + 1
    a = 0
    for b in ends:
        if b - a >= TASK_GRAMS or b == len(code):
            yield code[a:b], n[a:b]
            a = b


def _levels(code: np.ndarray, n: np.ndarray, j: int) -> list[_Nodes]:
    """The bit nodes of depths 2 to DEPTH."""
    return _nodes([((code >> 8 * (DEPTH + 1 - d) << 8) | (code & 255), n) for d in range(2, DEPTH + 1)], j)


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of depth 1's nodes and sums of their children's weights."""
    zeros, ones, inner = (np.zeros(1 << 16) for _ in range(3))
    for code, n in _parts(batches):
        for j in range(8):
            byte = code & 255
            at, bit = (code >> 40 << 8) | (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            zeros += np.bincount(at, n * (1 - bit), 1 << 16)
            ones += np.bincount(at, n * bit, 1 << 16)
            below = _levels(code, n, j)[0]
            inner += np.bincount(((below.key >> 16) << 8) | (below.key & 255), below.weight, 1 << 16)
    key = np.flatnonzero(zeros + ones)
    yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(x[key]) for x in (zeros, ones, inner)]], names=["key", "zeros", "ones", "inner"])


def _unknown(contexts: np.ndarray, levels: list[list[_Nodes]], top: _Top) -> np.ndarray:
    """The probability, after each context, of one byte that never occurred."""
    out, known = [], np.flatnonzero(top.known)
    for a in range(0, len(contexts), 1024):
        mine = contexts[a : a + 1024, None]
        chance = np.ones((len(mine), len(known)))
        for j, nodes in enumerate(levels):
            m = np.arange(1 << j, 2 << j)
            at = (mine >> 8 * (DEPTH - 1) << 8) | m
            state = [top.spent[at], top.left[at], top.now[at]]
            for d, node in enumerate(nodes, 2):
                want = (mine >> 8 * (DEPTH - d) << 8) | m
                at = np.minimum(np.searchsorted(node.key, want), len(node.key) - 1)
                state = _deeper(state, node.estimate[at], node.stop[at], node.seen[at] & (node.key[at] == want))
            p = state[2][:, known >> (8 - j)]
            chance *= np.where((known >> (7 - j)) & 1, p, 1 - p)
        out.append(np.maximum(1 - chance.sum(1), 1e-12) / max(1, 256 - len(known)))
    return np.concatenate(out)


def _downward(code: np.ndarray, n: np.ndarray, top: _Top) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    byte, chance, levels = code & 255, np.ones(len(code)), []
    new = ~top.known[byte]
    for j in range(8):
        m = (1 << j) | (byte >> (8 - j))
        nodes = _levels(code, n, j)
        at = (code >> 40 << 8) | m
        state = [top.spent[at], top.left[at], top.now[at]]
        for d, node in enumerate(nodes, 2):
            at = np.searchsorted(node.key, (code >> 8 * (DEPTH + 1 - d) << 8) | m)
            state = _deeper(state, node.estimate[at], node.stop[at], node.seen[at])
        chance *= np.where((byte >> (7 - j)) & 1, state[2], 1 - state[2])
        if new.any():
            levels.append(nodes)
    if new.any():
        contexts, at = np.unique(code[new] >> 8, return_inverse=True)
        chance[new] = _unknown(contexts, levels, top)[at]
    return np.log10(np.maximum(chance, 1e-30))


def costs(grams: DataFrame) -> DataFrame:
    """(gram, n, cost) for all of grams(gram, n), cost being the log10 of the probability of its byte after its context, as of
    fit() over those with n > 0, of every depth and without a bound on their number.

    The grams behind one pair of latest bytes are a subtree; tasks weigh their subtrees up to depth 2, the driver depths 1
    and 0 (at most 2^16 nodes), and tasks go down again. A task holds its grams and the nodes of about TASK_GRAMS of them, or
    of one pair of latest bytes if that has more."""
    spark = grams.sparkSession
    tasks = max(1, min(4096, grams.count() // TASK_GRAMS))
    dealt = grams.select("gram", "n").repartition(tasks, F.expr("shiftright(gram, 8) & 65535"))
    sums = dealt.mapInArrow(_upward, "key long, zeros double, ones double, inner double").groupBy("key")
    rows = sums.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("inner").alias("inner")).toArrow()
    top = spark.sparkContext.broadcast(_top(*(rows.column(c).to_numpy() for c in ("key", "zeros", "ones", "inner"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_turn(code)), pa.array(n), pa.array(_downward(code, n, top.value))], names=["gram", "n", "cost"])

    return stored(dealt.mapInArrow(run, "gram long, n long, cost double"), "costs")


@dataclass
class Hot:
    """Costs of some grams in tables of a slot for each hash; what finds its slot taken is in the next table."""

    tables: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def slots(gram: np.ndarray, size: int) -> np.ndarray:
        bits = size.bit_length() - 1
        return ((gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    @classmethod
    def of(cls, gram: np.ndarray, n: np.ndarray, cost: np.ndarray) -> Hot:
        order = np.argsort(n, kind="stable")  # the last of a slot, the most frequent, gets it
        gram, cost, tables = gram[order], cost[order].astype(np.float32), []
        while len(gram):
            size = 2 << (2 * len(gram)).bit_length() - 1
            at = cls.slots(gram, size)
            keys, values = np.full(size, -1, np.int64), np.zeros(size, np.float32)
            keys[at] = gram
            kept = keys[at] == gram
            values[at[kept]] = cost[kept]
            tables.append((keys, values))
            gram, cost = gram[~kept], cost[~kept]
        return cls(tables)

    def costs(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost of each gram or 0, places of those that aren't here)."""
        out, left = np.zeros(len(gram), np.float32), np.arange(len(gram))
        for keys, values in self.tables:
            at = self.slots(gram[left], len(keys))
            hit = keys[at] == gram[left]
            out[left[hit]] = values[at[hit]]
            left = left[~hit]
        return out, left


def hottest(found: DataFrame) -> Hot:
    """The most frequent grams of costs(), at most MOST_HOT."""
    steps = sorted({int(2 ** (i / 4)) for i in range(4 * 48)})
    sizes = found.agg(*[F.count_if(F.col("n") >= t).alias(str(t)) for t in steps]).first()
    least = next(t for t in steps if sizes[str(t)] <= MOST_HOT or t == steps[-1])
    table = found.where(F.col("n") >= least).select("gram", "n", "cost").toArrow()
    return Hot.of(*(table.column(c).to_numpy() for c in ("gram", "n", "cost")))


#: kind: 0 for a document's own row, 1 for a word of it and 2 for a gram of it, to be joined.
SCORED = "uid long, doc_id {}, held_out boolean, kind int, word long, times long, n_tokens long, known long, base double, score double, bytes long"


def score(docs: DataFrame, folds: int = 7, out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row of
    docs(doc_id, text).

    Learns from the rows whose crc32(doc_id as text) modulo folds is not out_fold, all of them and whole. Tokens are words,
    A-Z in lower case, and one end. base_score is the add-one unigram's log10 probability of them. score is the context tree's
    of the words joined by blanks and an end, which is the same sequence of tokens; bits_per_byte is its code length.

    A null text counts as empty, one token; a null id as the empty text for the fold. Each of repeated rows gets a row of its
    own with equal values. Without training rows all counts are 0 and the tree predicts little but ends. An empty table gives no
    rows; other columns are ignored. Every gram and context of the training rows makes the tree. The driver and each task hold the
    costs of at most MOST_HOT frequent grams and words above a share of the corpus, whose number that share bounds; every other
    gram and word is counted and joined on the cluster, words by a 64-bit hash."""
    spark = docs.sparkSession
    held = fold("doc_id", folds) == out_fold
    counts = stored(count(docs.select("text", held.alias("held_out"))), "counts")
    words = counts.where("word IS NOT NULL")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    tokens, kinds = sums["tokens"], sums["kinds"]
    grams = counts.where("gram IS NOT NULL").select("gram", "n")
    if not tokens:  # learns from a single end
        ends = spark.range(1).select(F.lit(int.from_bytes(END * (DEPTH + 1), "big")).cast("long").alias("gram"), F.lit(1).cast("long").alias("n"))
        grams = grams.union(ends).groupBy("gram").agg(F.sum("n").alias("n"))
    found = costs(grams)
    logs = {bytes(r["word"]): float(np.log10(r["n"] + 1)) for r in words.where(F.col("n") >= tokens * WORD_SHARE).toLocalIterator()}
    shared = spark.sparkContext.broadcast((hottest(found), logs))
    floor = float(np.log10(tokens + kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, logs = shared.value
        uid = TaskContext.get().partitionId() << 40
        digest, seed = xxhash.xxh64_intdigest, 42

        def part(batch: pa.RecordBatch, texts: list[bytes | None], uid: int) -> Iterator[pa.RecordBatch]:
            n = len(texts)
            uids = np.arange(uid, uid + n)
            n_tokens, known, base = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            rare, times, of, plain = [], [], [], []
            for i, text in enumerate(texts):
                tokens = canonical(text)
                plain.append(b" ".join(tokens) + END)
                tally = Counter(tokens)
                tally[b""] = 1
                n_tokens[i] = len(tokens) + 1
                total, hits = 0.0, 0
                for w, c in tally.items():
                    value = logs.get(w)
                    if value is None:
                        rare.append(digest(w, seed))
                        times.append(c)
                        of.append(i)
                    else:
                        total += c * value
                        hits += c
                base[i], known[i] = total, hits
            lengths = np.array([len(t or b"") for t in texts], np.int64)
            data, starts, sizes = _stream(plain)
            code = _codes(data)
            value, left = hot.costs(code)
            sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            starts = starts - DEPTH
            # Between texts lie grams of no text: they are neither added nor asked for.
            at = np.searchsorted(starts, left, "right") - 1
            real = left - starts[at] < sizes[at]
            asked, often = np.unique((at[real] << 48) | code[left[real]], return_counts=True)
            ids, outs = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids), ids, outs, pa.array(np.zeros(n, np.int32)), pa.array(uids), pa.nulls(n, pa.int64()), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(sums[starts + sizes] - sums[starts]), pa.array(lengths)],
                schema=target,
            )
            word = np.array(rare, np.uint64).view(np.int64)
            for kind, key, of, times in ((1, word, np.array(of, np.int64), times), (2, asked & ((1 << 48) - 1), asked >> 48, often)):
                m = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[of]), pa.nulls(m, ids.type), pa.nulls(m, pa.bool_()), pa.array(np.full(m, kind, np.int32)), pa.array(key), pa.array(times, pa.int64()), *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]],
                    schema=target,
                )

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a few texts at a time, CHUNK bytes unless one alone has more
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and len(texts) < 1 << 14 and (size < CHUNK or not texts):
                    texts.append(batch.column(2)[at + len(texts)].as_py())
                    size += len(texts[-1] or b"")
                yield from part(batch.slice(at, len(texts)), texts, uid)
                at += len(texts)
                uid += len(texts)

    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    target = pa.schema(
        [("uid", pa.int64()), ("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("kind", pa.int32()), ("word", pa.int64()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64())]
    )
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(run, SCORED.format(kind.simpleString()))
    rest = words.where(F.col("n") < tokens * WORD_SHARE).select(F.lit(1).alias("kind"), F.xxhash64("word").alias("word"), F.col("n").alias("seen"), F.lit(0.0).alias("cost"))
    rest = rest.union(found.select(F.lit(2), "gram", F.lit(0).cast("long"), "cost"))
    joined = rows.join(rest, ["kind", "word"], "left")
    hit = F.coalesce(F.col("times"), F.lit(0)) * (F.coalesce(F.col("seen"), F.lit(0)) > 0).cast("long")
    part = F.coalesce(F.col("times") * F.log10(F.coalesce(F.col("seen"), F.lit(0)) + 1), F.lit(0.0))
    byte = F.coalesce(F.col("times") * F.col("cost"), F.lit(0.0))
    whole = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(hit)).alias("n_known"), (F.max("base") + F.sum(part)).alias("base"), (F.max("score") + F.sum(byte)).alias("score"), F.max("bytes").alias("bytes"),
    )
    bits = F.when(F.col("bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("bytes")).otherwise(0.0)
    scores = whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score", bits.alias("bits_per_byte"),
    )
    return stored(scores, "scores")

"""Language identification: prediction by partial matching over bytes, one frozen context tree for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestack.llm.common import fold, stored

#: Longest context, in bytes.
ORDER = 3
#: Training text of a language: so many bytes at most, whole documents in the order of a hash.
TRAIN_BYTES = 400_000
#: Languages that are fitted, broadcast and scored at once; if there are more, the texts are read once for each so many.
AT_ONCE = 8
PAD = 32  # the byte before a text


def _codes(data: np.ndarray, length: int) -> np.ndarray:
    """The grams of so many bytes that end at each place from length - 1 on, as integers."""
    out = np.zeros(max(0, len(data) - length + 1), np.int64)
    for i in range(length):
        out = (out << 8) | data[i : len(data) - length + 1 + i]
    return out


@dataclass
class Model:
    """symbol: byte to column; state: last three columns to a row; cost[language]: bits of a column after a row."""

    languages: list[str]
    symbol: np.ndarray
    width: int
    state: np.ndarray
    cost: np.ndarray

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of each text under each language, one row for each text."""
        out = np.zeros((len(texts), len(self.languages)))
        group, size = [], 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t)
            if size > 4 << 20 or i + 1 == len(texts):
                self._group(texts, group, out)
                group, size = [], 0
        return out

    def _group(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        pad = bytes([PAD]) * ORDER
        data = np.frombuffer(pad + pad.join(texts[i] for i in group), np.uint8)
        s = self.symbol[data]
        w = self.width
        context = (s[:-3].astype(np.int32) * w + s[1:-2]) * w + s[2:-1]
        place = self.state[context] * w + s[3:]
        sizes = np.array([len(texts[i]) for i in group])
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
        full = sizes > 0
        for k in range(len(self.languages)):
            bits = self.cost[k].ravel()[place]
            sums = np.concatenate([[0.0], np.cumsum(bits, dtype=np.float64)])
            out[np.array(group)[full], k] = (sums[starts + sizes] - sums[starts])[full]


def fit(texts: dict[str, list[bytes]]) -> Model:
    """Frozen statistics of the texts of each language.

    A context that was followed by n bytes of t kinds gives a byte with count c the probability c / (n + t) and passes
    t / (n + t) on to the context one byte shorter; the empty context passes on to the uniform distribution over bytes.
    Contexts that no language has are those of their longest known suffix, whose escape is then certain."""
    languages = sorted(texts)
    pad = bytes([PAD]) * ORDER
    streams = {k: np.frombuffer(pad + pad.join(texts[k]), np.uint8) for k in languages}
    seen = np.unique(np.concatenate([np.array([PAD], np.uint8), *streams.values()]))
    w = len(seen) + 1  # the last column stands for every byte that was not seen
    symbol = np.full(256, len(seen), np.uint8 if w <= 256 else np.uint16)
    symbol[seen] = np.arange(len(seen))
    unseen = max(1, 256 - len(seen))
    base = np.full(w, 1 / 256)
    base[-1] = unseen / 256  # the whole class; a byte of it costs that and log2(unseen)
    grams = {}
    for k in languages:
        s = symbol[streams[k]].astype(np.int64)
        text = np.ones(len(s) - ORDER, bool)  # the places of texts, without the padding between them
        for end in np.cumsum([len(t) + ORDER for t in texts[k]])[:-1]:
            text[end - ORDER : end] = False
        for d in range(ORDER + 1):
            code = np.zeros(len(s) - ORDER, np.int64)
            for i in range(d + 1):
                code = code * w + s[ORDER - d + i : len(s) - d + i]
            grams[k, d] = np.unique(code[text], return_counts=True)
    rows = {0: np.zeros(1, np.int64)}
    for d in range(1, ORDER + 1):
        rows[d] = np.unique(np.concatenate([grams[k, d][0] // w for k in languages]))
    first = np.concatenate([[0], np.cumsum([len(rows[d]) for d in range(ORDER + 1)])])
    cost = np.zeros((len(languages), int(first[-1]), w), np.float32)
    for i, k in enumerate(languages):
        table = np.zeros((int(first[-1]), w))
        for d in range(ORDER + 1):
            code, count = grams[k, d]
            at = np.searchsorted(rows[d], code // w)
            shorter = np.searchsorted(rows[d - 1], rows[d] % w ** (d - 1)) + first[d - 1] if d else None
            below = table[shorter] if d else np.broadcast_to(base, (1, w))
            n, kinds = np.bincount(at, count, len(rows[d])), np.bincount(at, minlength=len(rows[d]))
            part = below * np.where(n > 0, kinds / np.maximum(n + kinds, 1), 1.0)[:, None]
            part[at, code % w] += count / (n + kinds)[at]
            table[first[d] : first[d + 1]] = part
        cost[i] = -np.log2(table)
    cost[:, :, -1] += np.log2(unseen)
    state = np.zeros(w**ORDER, np.int32)
    every = np.arange(w**ORDER)
    for d in range(1, ORDER + 1):
        tail = every % w**d
        at = np.minimum(np.searchsorted(rows[d], tail), len(rows[d]) - 1)
        known = rows[d][at] == tail
        state[known] = first[d] + at[known]
    return Model(languages, symbol, w, state, cost)


def languages(docs: DataFrame, folds: int, out_fold: int) -> list[Row]:
    """lang, bytes and docs of every language that can be learnt, by name."""
    sized = _known(docs, folds, out_fold).select("lang", F.octet_length("text").alias("n"))
    return sorted(sized.groupBy("lang").agg(F.sum("n").alias("bytes"), F.count("*").alias("docs")).collect(), key=lambda r: r["lang"])


def _known(docs: DataFrame, folds: int, out_fold: int) -> DataFrame:
    return docs.where("text IS NOT NULL AND lang IS NOT NULL").where(fold("doc_id", folds) != out_fold)


def training_texts(docs: DataFrame, stats: list[Row], folds: int, out_fold: int, train_bytes: int = TRAIN_BYTES) -> dict[str, list[bytes]]:
    """At most train_bytes bytes of each language of stats, from whole documents in the order of a hash of id and text; the
    last one is cut. Only a bounded sample of rows is ordered: a hash threshold keeps about enough of each language."""
    known = _known(docs, folds, out_fold)
    out: dict[str, list[bytes]] = {}
    # Enough rows for the bytes wanted with a margin, in expectation; the hash is uniform over texts.
    share = {r["lang"]: min(1.0, 2.0 * (train_bytes + 20 * r["bytes"] / r["docs"]) / max(1, r["bytes"])) for r in stats}
    limit = F.element_at(F.create_map(*[F.lit(x) for r in stats for x in (r["lang"], share[r["lang"]])]), F.col("lang"))
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    near = known.where(F.col("lang").isin(list(share))).withColumn("rank", rank).where(F.col("rank") < limit * float(1 << 30))
    cut = near.select("lang", "rank", F.substring(F.col("text").cast("binary"), 1, train_bytes).alias("text"))
    upto = Window.partitionBy("lang").orderBy("rank", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0))
    taken = cut.withColumn("before", before).where(F.col("before") < train_bytes)
    for r in taken.orderBy("lang", "rank").toLocalIterator():
        out.setdefault(r["lang"], []).append(bytes(r["text"])[: train_bytes - r["before"]].lower())
    return out


def identify(docs: DataFrame, folds: int = 3, out_fold: int = 1, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte for every row of docs(doc_id, text, lang).

    Learns from documents with text and lang whose crc32(doc_id as text) modulo folds is not out_fold, at most train_bytes
    bytes of each of all languages. Every byte of a text is scored under every language; the shortest code wins, ties by name.
    score is the probability of the winner if each byte counted by its share: the softmax of minus the code lengths per
    byte times at most 64 bytes. `und` with score 0 for a null text or one without a letter, and for all texts if nothing was
    learnt. Null ids are as the empty text for the fold; a null lang is only not learnt from; equal texts get equal
    answers; other columns are ignored."""
    stats = languages(docs, folds, out_fold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    found = found.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("odds"), F.lit(0.0).alias("bits_per_byte"))
    if not stats:
        found = found.select("doc_id", "lang_pred", F.lit(0.0).alias("score"), "bits_per_byte")
    for at in range(0, len(stats), AT_ONCE):
        texts = training_texts(docs, stats[at : at + AT_ONCE], folds, out_fold, train_bytes)
        found = _scored(found, fit(texts), kind, at + AT_ONCE >= len(stats))
    found = stored(found, "languages")
    return found.select("doc_id", (fold("doc_id", folds) == out_fold).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def _scored(rows: DataFrame, model: Model, kind: str, last: bool) -> DataFrame:
    """rows(doc_id, text, letter, lang_pred, odds, bits_per_byte) after the model's languages, whose names come after those
    before: the best so far, its bits per byte, and the sum of all odds against it. The last one gives the scores instead."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            letters = batch.column(2).to_pylist()
            pred, odds, rate = (batch.column(c).to_pylist() for c in (3, 4, 5))
            if texts:
                low = [(t or b"").lower() for t in texts]
                bits = model.lengths(low)
                size = np.maximum(1, [len(t) for t in low])
                best = bits.argmin(1)
                per = bits / size[:, None]
                weight = np.minimum(size, 64)
                sums = np.exp2(-(per - per.min(1, keepdims=True)) * weight[:, None]).sum(1)
                for i in range(len(texts)):
                    if letters[i]:
                        mine = per[i, best[i]]
                        if not odds[i]:
                            pred[i], odds[i], rate[i] = model.languages[best[i]], sums[i], mine
                        elif mine < rate[i]:
                            pred[i], odds[i], rate[i] = model.languages[best[i]], sums[i] + odds[i] * np.exp2((mine - rate[i]) * weight[i]), mine
                        else:
                            odds[i] += sums[i] * np.exp2((rate[i] - mine) * weight[i])
            if last:
                score = [1 / x if x else 0.0 for x in odds]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_byte"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pred, pa.string()), pa.array(odds, pa.float64()), pa.array(rate, pa.float64())], names=batch.schema.names)

    if last:
        return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")
    return stored(rows.mapInArrow(run, f"doc_id {kind}, text binary, letter boolean, lang_pred string, odds double, bits_per_byte double"), "scored")

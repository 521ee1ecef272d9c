"""Quality classifier: regularised quadratic discriminant analysis over statistics of whole texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import fold, scratch, stored

#: What is counted in a text: words, bytes, the longest word, then what has a share of the bytes and what has a share of the words.
OF_BYTES = ("alpha", "digit", "space", "punct", "upper")
OF_WORDS = ("upper_words", "word_variety", "stops", "commas", "short_words", "top_word", "repeated_next", "symbol_words", "word_bytes")
COUNTS = ("words", "bytes", "longest", *OF_BYTES, *OF_WORDS)
FEATURES = ("log_words", "log_longest", *OF_BYTES, *OF_WORDS)
#: So many of the words that the most documents have are common words; learnt, as the usual shares are.
COMMON_WORDS = 128
#: A text is taken to have had so many bytes or words of the usual shares before it is read: a short text says little.
PRIOR_BYTES, PRIOR_WORDS = 100, 16
#: Different words of a task that are counted before they are passed on.
MOST_TALLY = 200_000
_SYMBOL = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]")
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def statistics(text: bytes, common: frozenset[bytes]) -> list[float]:
    """The COUNTS of one whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    alpha, digit, space = counts[_ALPHA].sum(), counts[48:58].sum(), counts[_SPACE].sum()
    tally = Counter(words)
    marked = sum(c for w, c in tally.items() if _SYMBOL.search(w))
    shouted = sum(c for w, c in tally.items() if len(w) > 1 and w.isupper())
    stops = sum(c for w, c in tally.items() if w.lower() in common)
    short = sum(c for w, c in tally.items() if len(w) <= 3)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        len(words), len(text), max(map(len, tally), default=0), alpha, digit, space, len(text) - alpha - digit - space, counts[65:91].sum(),
        shouted, len(tally), stops, counts[44], short, max(tally.values(), default=0), same, marked, len(text) - space,
    ]


@dataclass(frozen=True)
class Settings:
    toward_pooled: float = 0.15  # shrinkage of a class covariance to the pooled one
    toward_sphere: float = 0.02  # then to the sphere of the same trace
    threshold: float = 0.3


def transformed(counts: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """FEATURES of COUNTS: shares smoothed toward the usual ones, and logs of what is long-tailed, so that classes are nearer to
    normal."""
    words, size, longest = counts[:, 0], counts[:, 1], counts[:, 2]
    weight = np.array([PRIOR_BYTES] * len(OF_BYTES) + [PRIOR_WORDS] * len(OF_WORDS))
    whole = np.column_stack([size] * len(OF_BYTES) + [words] * len(OF_WORDS))
    share = (counts[:, 3:] + usual * weight) / (whole + weight)
    share[:, :-1] = np.log(share[:, :-1] + 0.01)
    share[:, -1] = np.log1p(share[:, -1])
    return np.column_stack([np.log1p(words), np.log1p(longest), share])


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text").cast("binary").alias("text"))


def common_words(docs: DataFrame, folds: int) -> frozenset[bytes]:
    """The words, A-Z in lower case, that the most documents outside the held-out fold have, of equal ones the least by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def out():
            table = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])
            tally.clear()
            return table

        for batch in batches:
            for text in batch.column(0):
                tally.update(set((text.as_py() or b"").lower().split()))
                if len(tally) > MOST_TALLY:
                    yield out()
        yield out()

    counts = _texts(docs.where(fold("doc_id", folds) != 0)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect())


def features(docs: DataFrame, common: frozenset[bytes]) -> DataFrame:
    """(doc_id, f), the COUNTS of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or b"", common) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, f array<double>")


def usual_shares(have: DataFrame, folds: int) -> np.ndarray:
    """The mean shares of the documents outside the held-out fold that have at least PRIOR_WORDS words; 0 if there are none."""
    at = {name: F.col("f")[i] for i, name in enumerate(COUNTS)}
    shares = [at[n] / at["bytes"] for n in OF_BYTES] + [at[n] / at["words"] for n in OF_WORDS]
    means = have.where((fold("doc_id", folds) != 0) & (at["words"] >= PRIOR_WORDS)).agg(*[F.avg(x).alias(f"s{i}") for i, x in enumerate(shares)]).first()
    return np.array([x or 0.0 for x in means])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(COUNTS)) if len(column) else np.zeros((0, len(COUNTS)))


def moments(rows: DataFrame, usual: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """{label: (n, sum, sum of outer products)} over rows(label, f): partial sums by task, a row for each task and
    class; what reaches the driver is bounded by the number of tasks and the features squared."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = transformed(_matrix(batch.column(1)), usual)
            for k in total:
                part = x[label == k]
                total[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        for k, v in total.items():
            if v[0]:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["label", "m"])

    parts = rows.mapInArrow(run, "label int, m array<double>")
    # Summed by place before the driver sees them.
    summed = parts.select("label", F.posexplode("m").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["label"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return {k: (int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


@dataclass
class Model:
    """Class densities over standardised statistics, each kept as mean, inverse Cholesky factor and log determinant."""

    center: np.ndarray
    scale: np.ndarray
    prior: float
    classes: dict[int, tuple[np.ndarray, np.ndarray, float]] | None
    usual: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Probability of label 1; the prior where one class was never seen."""
        if self.classes is None:
            return np.full(len(counts), self.prior)
        x = transformed(counts, self.usual)
        z = np.clip((x - self.center) / self.scale, -8, 8)
        log = {}
        for k, (mean, inverse, logdet) in self.classes.items():
            u = (z - mean) @ inverse.T
            log[k] = -0.5 * np.einsum("ij,ij->i", u, u) - logdet
        gap = log[1] - log[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], usual: np.ndarray, settings: Settings = Settings()) -> Model:
    d = len(FEATURES)
    n = {k: sums[k][0] if k in sums else 0 for k in (0, 1)}
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    if min(n.values()) < 2:
        return Model(np.zeros(d), np.ones(d), prior, None, usual)
    total = n[0] + n[1]
    center = (sums[0][1] + sums[1][1]) / total
    scale = np.sqrt(np.maximum(np.diag(sums[0][2] + sums[1][2]) / total - center**2, 1e-8))
    means, covs = {}, {}
    for k in (0, 1):
        mean = sums[k][1] / n[k]
        cov = sums[k][2] / n[k] - np.outer(mean, mean)
        means[k], covs[k] = (mean - center) / scale, cov / np.outer(scale, scale)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    classes = {}
    for k in (0, 1):
        cov = (1 - settings.toward_pooled) * covs[k] + settings.toward_pooled * pooled
        cov = (1 - settings.toward_sphere) * cov + settings.toward_sphere * np.trace(cov) / d * np.eye(d)
        factor = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        classes[k] = (means[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return Model(center, scale, prior, classes, usual)


def learn(have: DataFrame, labels: DataFrame, folds: int, settings: Settings) -> Model:
    """Fits features(doc_id, f) with labels(doc_id, quality), without the fold that is held out."""
    kept = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1)").distinct()
    train = have.where(fold("doc_id", folds) != 0).join(kept, "doc_id").select("label", "f")
    usual = usual_shares(have, folds)
    return fit(moments(train, usual), usual, settings)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text).

    Learns from the labelled rows whose crc32(doc_id as text) modulo folds is not 0, all of them: class moments are sums,
    so nothing is sampled. Common words and usual shares are learnt from the texts of all rows outside that fold. Only statistics
    of the whole text enter a score. Null and empty texts have the statistics of no
    words and get a score like others. Labels that are null or neither 0 nor 1 are ignored; if a document has both
    labels, each counts once. Null ids count as held out only if the empty text's remainder is 0; equal texts get equal
    scores; if a class has fewer than two rows, all scores are the smoothed share of label 1. Other columns are ignored."""
    have = stored(features(docs, common_words(docs, folds)), "features")
    model = learn(have, labels, folds, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = have.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs(doc_id, text, ...), with all their columns, whose score reaches the threshold; each row is judged by
    its own text, so nulls, repeated ids and ties need no join. Learns as classify does."""
    # The statistics are joined with the labels, not the texts, though that reads the texts once more.
    common = common_words(docs, folds)
    with scratch(docs.sparkSession):  # the model is on the driver
        model = learn(stored(features(docs, common), "features"), labels, folds, settings)
    place, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((t.as_py() or "").encode(), common) for t in batch.column(text)]
            x = np.array(rows, np.float64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(batch.columns, names=place).filter(pa.array(model.scores(x) >= settings.threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import quality as q

from .common import odd, table, words


def corpus(n=600):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = words(r.randrange(20, 200), i) + " and the of to." if good else " ".join(["BUY!!", "now!!", "$$$"] * r.randrange(10, 60))
        docs.append((i, text, "en", "a"))
        labels.append((i, int(good), 0, "x"))
    return docs, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def dense(docs, labels):
    """The same scores from matrices."""
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in docs])
    y = np.array([k for _, k, *_ in labels])
    often = Counter(w for (_, t, *_), k in zip(docs, train, strict=True) if k for w in set(t.lower().encode().split()))
    common = frozenset(sorted(often, key=lambda w: (-often[w], w))[: q.COMMON_WORDS])
    counts = np.array([q.statistics(t.encode(), common) for _, t, *_ in docs], float)
    long = counts[train & (counts[:, 0] >= q.PRIOR_WORDS)]
    usual = np.hstack([long[:, 3:8] / long[:, [1]], long[:, 8:] / long[:, [0]]]).mean(0)
    x = q.transformed(counts, usual)
    center, scale = x[train].mean(0), np.sqrt(np.maximum(x[train].var(0), 1e-8))
    z = (x - center) / scale
    s = q.Settings()
    covs = {k: np.cov(z[train & (y == k)].T, bias=True) for k in (0, 1)}
    pooled = sum(covs[k] * (train & (y == k)).sum() for k in covs) / train.sum()
    log = {}
    z = np.clip(z, -8, 8)
    for k in (0, 1):
        c = (1 - s.toward_pooled) * covs[k] + s.toward_pooled * pooled
        c = (1 - s.toward_sphere) * c + s.toward_sphere * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        m = ((x[train & (y == k)] - center) / scale).mean(0)
        log[k] = -0.5 * np.einsum("ij,ij->i", (z - m) @ np.linalg.inv(c), z - m) - 0.5 * np.linalg.slogdet(c)[1]
    n1 = (train & (y == 1)).sum()
    p = (n1 + 1) / (train.sum() + 2)
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log(p / (1 - p)), -500, 500)))


def test_scores_match_dense_matrices_and_held_out_labels(spark):
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in q.classify(table(spark, docs), label_table(spark, labels)).collect()}
    want = dense(docs, labels)
    assert max(abs(got[i]["score"] - want[i]) for i in range(len(docs))) < 1e-6
    held = [i for i in got if got[i]["held_out"]]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    kept = {r["doc_id"] for r in q.accepted(table(spark, docs), label_table(spark, labels)).collect()}
    assert kept == {i for i in got if got[i]["predicted"]}


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(200)
    flipped = [(i, 1 - k if zlib.crc32(str(i).encode()) % 5 == 0 else k, t, x) for i, k, t, x in labels]
    a, b = ({r["doc_id"]: r["score"] for r in q.classify(table(spark, docs), label_table(spark, y)).collect()} for y in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


def test_odd_rows_and_missing_classes(spark):
    docs, labels = corpus(80)
    rows = [(i + 100, *x) for i, *x in docs] + odd()
    labels = [(i + 100, k, t, x) for i, k, t, x in labels] + [(None, 1, 0, "x"), (200, None, 0, "x"), (201, 7, 0, "x"), (10**9, 0, 0, "x")]
    got = q.classify(table(spark, rows), label_table(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert q.accepted(table(spark, rows), label_table(spark, labels)).columns == table(spark, rows).columns
    one = q.classify(table(spark, rows), label_table(spark, [x for x in labels if x[1] == 1])).select("score").distinct().collect()
    assert len(one) == 1 and one[0][0] > 0.9
    assert {r["score"] for r in q.classify(table(spark, docs), label_table(spark, [])).collect()} == {0.5}
    assert q.classify(table(spark, []), label_table(spark, labels)).count() == 0

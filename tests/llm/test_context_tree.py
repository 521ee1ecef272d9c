import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import context_tree as c

from .common import odd, table, words


def slow_scores(train, ask):
    """Context-tree weighting with dictionaries: log10 of each text."""
    counts = Counter()
    pad = c.END * c.DEPTH
    for t in train:
        t = pad + t
        for i in range(c.DEPTH, len(t)):
            for d in range(c.DEPTH + 1):
                for j in range(8):
                    counts[t[i - d : i], (1 << j) | (t[i] >> (8 - j)), (t[i] >> (7 - j)) & 1] += 1
    nodes = {(x, m) for x, m, _ in counts}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    children = {}
    for x, m in nodes:
        if x:
            children.setdefault((x[1:], m), []).append((x, m))
    log, stop = {}, {}
    for x, m in sorted(nodes, key=lambda n: -len(n[0])):
        own = kt(counts[x, m, 0], counts[x, m, 1])
        if len(x) == c.DEPTH:
            log[x, m], stop[x, m] = own, 1.0
        else:
            inner = sum(log[k] for k in children[x, m])
            both = np.logaddexp(own, inner) - math.log(2)
            log[x, m], stop[x, m] = both, math.exp(own - math.log(2) - both)

    def one(context, m):
        spent, left, now = 0.0, 1.0, 0.5
        for d in range(c.DEPTH + 1):
            x = context[len(context) - d :]
            if (x, m) in nodes:
                p = (counts[x, m, 1] + 0.5) / (counts[x, m, 0] + counts[x, m, 1] + 1)
                now = spent + left * p
                spent, left = spent + left * stop[x, m] * p, left * (1 - stop[x, m])
        return now

    seen = {t[i] for t in train for i in range(len(t))} | {10}
    out = []
    for t in ask:
        t, total = pad + t, 0.0
        for i in range(c.DEPTH, len(t)):
            context = t[i - c.DEPTH : i]

            def chance(byte, context=context):
                p = 1.0
                for j in range(8):
                    q = one(context, (1 << j) | (byte >> (8 - j)))
                    p *= q if (byte >> (7 - j)) & 1 else 1 - q
                return p

            total += math.log10(chance(t[i]) if t[i] in seen else max(1e-12, 1 - sum(map(chance, seen))) / (256 - len(seen)))
        out.append(total)
    return out


def text_of(t):
    return b" ".join(c.canonical(t)) + c.END


def test_scores_match_the_definition(spark):
    rows = [(i, words(8, i, 30), "en", "a") for i in range(14)] + [(20, "unseen é bytes Z9", "en", "a"), (21, "", "en", "a"), (22, None, "en", "a")]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [text_of((t or "").encode()) for i, t, *_ in rows if i not in held]
    want = slow_scores(train, [text_of((t or "").encode()) for _, t, *_ in rows])
    got = {r["doc_id"]: r for r in c.score(table(spark, rows)).collect()}
    for (i, *_), w in zip(rows, want, strict=True):
        assert got[i]["score"] == pytest.approx(w, rel=1e-4, abs=1e-4) and got[i]["held_out"] == (i in held)


def test_probabilities_of_a_context_add_up():
    grams = [c._grams([text_of(words(300, s, 50).encode()) for s in range(5)])]
    tables = []
    for d in range(c.DEPTH + 1):
        k, at = np.unique(grams[0][0] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        tables.append((k, np.bincount(at, grams[0][1], len(k)).astype(np.int64)))
    model = c.fit(tables)
    p = 10.0 ** model.cost.astype(np.float64)
    seen = model.width - 1
    assert np.allclose(p[:, :seen].sum(1) + p[:, seen] * (256 - seen), 1, atol=1e-4)


def test_base_scores_match_brute_force(spark, monkeypatch):
    rows = [(i, words(30, i, 90).upper() if i % 4 == 0 else words(30, i, 90), "en", "a") for i in range(60)] + odd(2000)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t, *_ in rows]
    counts = Counter(w for (i, *_), t in zip(rows, tokens, strict=True) if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, *_), t in zip(rows, tokens, strict=True))
    for share in (1 / 500_000, 0.02):  # all words on the spot, and most of them by the join
        monkeypatch.setattr(c, "WORD_SHARE", share)
        got = c.score(table(spark, rows)).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_the_tree_beats_the_unigram_on_held_out_words(spark):
    rows = [(i, words(60, i, 3000), "en", "a") for i in range(300)]
    got = [r for r in c.score(table(spark, rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_tables(spark):
    assert c.score(table(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = c.score(table(spark, [(held, "a b", "en", "a")])).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3) and r["base_score"] == 0 and r["score"] < 0


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 40, 0.5), [1e3 + 0.5, 1e9]])
    assert np.allclose(c._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_rare_contexts_and_grams_count_as_all_others(spark, monkeypatch):
    """More contexts of a depth than a table of 2^15 holds, all of them of one or two occurrences, and few costs on the spot."""
    rows = [(i, "".join(chr(97 + x) for x in np.random.default_rng(i // 2).integers(0, 26, 6000)), "en", "a") for i in range(16)] + [(99, "never seen: ÄÖ 7", "en", "a")]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [text_of(t.encode()) for i, t, *_ in rows if i not in held]
    assert len({t[i : i + c.DEPTH] for t in train for i in range(len(t))}) > 1 << 15
    code, n = c._grams(train)
    tables = []
    for d in range(c.DEPTH + 1):
        k, at = np.unique(code & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        tables.append((k, np.bincount(at, n, len(k)).astype(np.int64)))
    whole = c.fit(tables).scores([text_of(t.encode()) for _, t, *_ in rows])
    for most in (1 << 20, 50):
        monkeypatch.setattr(c, "MOST_HOT", most)
        got = {r["doc_id"]: r["score"] for r in c.score(table(spark, rows)).collect()}
        assert [got[i] for i, *_ in rows] == pytest.approx(list(whole), rel=1e-4)

import math
import random
import zlib

import pytest

from lodestack.llm import language as l

from .common import odd, table

PARTS = {"aa": ["the", "ing", "th", "er"], "bb": ["sch", "ung", "ei", "en"], "cc": ["que", "eau", "é", "la"]}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


class Slow:
    """PPM with one dictionary for each context, as written in the definition."""

    def __init__(self, texts, alphabet):
        self.count = {}
        for t in texts:
            t = bytes([l.PAD]) * l.ORDER + t
            for i in range(l.ORDER, len(t)):
                for d in range(l.ORDER + 1):
                    c = self.count.setdefault(t[i - d : i], {})
                    c[t[i]] = c.get(t[i], 0) + 1

    def p(self, context, byte):
        below = 1 / 256 if not context else self.p(context[1:], byte)
        seen = self.count.get(context) if context else self.count.get(b"")
        if not seen:
            return below
        n, kinds = sum(seen.values()), len(seen)
        return seen.get(byte, 0) / (n + kinds) + kinds / (n + kinds) * below

    def bits(self, t):
        t = bytes([l.PAD]) * l.ORDER + t
        return -sum(math.log2(self.p(t[i - l.ORDER : i], t[i])) for i in range(l.ORDER, len(t)))


def test_code_lengths_match_the_definition():
    texts = {k: [text(k, 60, s).encode() for s in range(4)] for k in PARTS}
    model = l.fit(texts)
    ask = [b"", b"x", text("aa", 20, 9).encode(), text("cc", 20, 9).encode(), "ÄÖ zz 99 \x00".encode(), b"the the"]
    got = model.lengths(ask)
    for i, k in enumerate(model.languages):
        slow = Slow(texts[k], None)
        for j, t in enumerate(ask):
            assert got[j, i] == pytest.approx(slow.bits(t), rel=1e-4, abs=1e-3)


def test_held_out_languages(spark):
    docs = [(i, text(k, 5 + i % 40, i), k, "a") for i in range(240) for k in [list(PARTS)[i % 3]]]
    wrong = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else k, s) for i, t, k, s in docs]
    for rows in (docs, wrong):  # labels of the held-out fold are never read
        got = {r["doc_id"]: r for r in l.identify(table(spark, rows)).collect()}
        assert all(got[i]["lang_pred"] == k and 0 < got[i]["score"] <= 1 for i, _, k, _ in docs)
        assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    small = {r["doc_id"]: r["lang_pred"] for r in l.identify(table(spark, docs), train_bytes=2000).collect()}
    assert sum(small[i] == k for i, _, k, _ in docs) > 0.95 * len(docs)


def test_odd_rows_and_empty_tables(spark):
    rows = odd() + [(50 + i, text("aa", 30, i), "aa", "a") for i in range(10)] + [(70, text("bb", 30, 1), None, "a")]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in l.identify(table(spark, rows)).collect()]
    assert len(got) == len(rows)
    und = {i for i, p, s in got if p == "und"}
    assert {1, 2, 3, 11} <= und and all(s == 0 for i, p, s in got if p == "und") and 4 not in und
    assert l.identify(table(spark, [])).count() == 0
    none = l.identify(table(spark, [(1, "some text", None, "a")])).first()
    assert none["lang_pred"] == "und" and none["score"] == 0


def test_every_language_of_many_is_learnt(spark):
    names = [f"l{k:02d}" for k in range(36)]
    part = lambda k, s: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" * 2 for x in random.Random(f"{k} {s}").choices("xyz", k=30))
    rows = [(100 * k + s, part(k, s), g, "a") for k, g in enumerate(names) for s in range(5)]
    got = {r["doc_id"]: r for r in l.identify(table(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g, _ in rows)
    train = {g: [t.encode() for i, t, x, _ in rows if x == g and zlib.crc32(str(i).encode()) % 3 != 1] for g in names}
    model = l.fit(train)
    for i, t, _, _ in rows[::9]:
        per = model.lengths([t.encode()])[0] / len(t)
        assert got[i]["score"] == pytest.approx(1 / sum(2 ** (-(x - per.min()) * min(64, len(t))) for x in per), rel=1e-3)

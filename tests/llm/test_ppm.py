"""Prediction by partial matching against a plain trie, symbol by symbol."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pipelens.llm import ppm

TEXTS = ["the cat sat on the mat", "The dog sat.", "", None, "a a a a", "zebra  \t quiz\n", "the cat", "é ü", "x" * 3000, "unseen words qqq"]


def tokens(text):
    return (text or "").encode().lower().split()


class Trie:
    """Counts of every context up to an order, and escape method C with exclusion, one symbol at a time."""

    def __init__(self, order):
        self.order, self.counts = order, defaultdict(Counter)

    def symbols(self, text):
        return [*b" ".join(tokens(text)), 256]

    def learn(self, text):
        s = [256] * self.order + self.symbols(text)
        for i in range(self.order, len(s)):
            for k in range(self.order + 1):
                self.counts[tuple(s[i - k : i])][s[i]] += 1

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(tuple(context[len(context) - k :]))
            if not seen:
                continue
            live = {s: n for s, n in seen.items() if s not in excluded}
            if live:
                total, escape = sum(live.values()), len(live) if len(seen) < 257 else 0
                if symbol in live:
                    return p * live[symbol] / (total + escape)
                p *= escape / (total + escape)
            excluded = set(seen)
        return p / (257 - len(excluded))

    def log10(self, text):
        s = [256] * self.order + self.symbols(text)
        return sum(math.log10(self.probability(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def brute(rows, order=5, mod=7, held=2):
    train = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % mod != held]
    trie = Trie(order)
    for t in train:
        trie.learn(t)
    c = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*tokens(t), None]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, zlib.crc32(str(i).encode() if i is not None else b"") % mod == held, len(w), sum(c[x] > 0 for x in w), n, base, trie.log10(t)))
    return out


def test_scores_are_those_of_a_trie(spark):
    rows = list(enumerate(TEXTS)) + [(20 + i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, "the null id")]
    got = sorted(map(tuple, ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_probabilities_sum_to_one():
    trie = Trie(3)
    for t in TEXTS[:3]:
        trie.learn(t)
    for context in ([116, 104, 101], [256, 256, 256], [1, 2, 3]):
        assert sum(trie.probability(context, s) for s in range(257)) == pytest.approx(1)


def test_other_order_and_no_training(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS[:4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.score(df, order=2).collect()}
    want = {w[0]: w[6] for w in brute(rows, order=2)}
    assert got == pytest.approx(want)
    held = spark.createDataFrame([(i, "ab c") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    for r in ppm.score(held).collect():
        assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(5 * math.log10(1 / 257))


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, chunk int, blob string, word string, gram int, train string, score int"
    assert ppm.score(spark.createDataFrame([], schema)).count() == 0
    got = ppm.score(spark.createDataFrame([(1, "a b", 1, "x", "y", 2, "z", 3)], schema)).first()
    assert (got.doc_id, got.n_tokens) == (1, 3)


def test_grams_of_pieces_are_those_of_single_texts():
    texts = [b"ab", b"", b"abc d"]
    grams, of = ppm.grams_of(texts, 2)
    alone = [ppm.grams_of([t], 2)[0] for t in texts]
    assert np.array_equal(grams, np.concatenate(alone)) and of.tolist() == [0] * 3 + [1] + [2] * 6


def test_many_chunks_parts_and_merges_make_no_difference(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ppm.score(df.coalesce(1)).collect()), key=repr)
    for name, value in (("FAN", 2), ("ANSWERS", 3), ("PART_BYTES", 500)):
        monkeypatch.setattr(ppm, name, value)
    got = sorted(map(tuple, ppm.score(df.repartition(13)).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-12)


def test_blocks_of_contexts_cost_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    grams, _ = ppm.distinct([bytes(rng.choice([97, 98, 99, 32], 4000).astype(np.uint8)) for _ in range(3)], 5)
    n = rng.integers(0, 4, len(grams)).astype(float)
    low, at = np.unique(grams & ((1 << 27) - 1), return_inverse=True)
    total = np.bincount(at, weights=n)
    base = ppm.Base(low[total > 0], total[total > 0])
    want = ppm.costs(grams, n, base, 5)
    monkeypatch.setattr(ppm, "BLOCK", 100)
    assert np.allclose(ppm.priced(grams, n, base, 5), want, rtol=1e-12) and want.max() <= 0

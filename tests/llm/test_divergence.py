"""The divergence audit against a plain version over all groups and terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pipelens.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, k):
    docs = [tuple(x or "" for x in d) for d in docs]
    in_docs, count, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        in_docs[lang].update(set(terms))
        count[lang, source].update(terms)
        whole[lang].update(terms)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in {d[1:] for d in docs}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept} if kept else {}  # noqa: E731, B023
        p, q = prob(count[lang, source]), prob(whole[lang])
        pair = []
        for other in {d[2] for d in docs if d[1] == lang} - {source}:
            o = prob(count[lang, other])
            pair.append((sum(f(p[t], o[t]) for t in kept), other))
        term = [(f(p[t], q[t]), t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pair, len(pair)), ("term", term, k)):
            for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, v, rank))
    return sorted(out)


def corpus(seed=3, n=400, skew=1.3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéжA😀" for b in "xyzŽ"] + ["Mixed", "mixed", "MIXED"]
    docs = []
    for _ in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "Ž", "😀"])
        lang = rng.choice(["en", "en", "de", None])
        own = words[hash_of(source) % 20 :]
        text = "".join(own[min(int(rng.expovariate(skew / 8)), len(own) - 1)] + rng.choice([" ", "1", "_", "\n", "\x7f", "@["]) for _ in range(rng.randrange(12)))
        docs.append((text, lang, source))
    docs += [(None, "en", "none"), ("", "en", "s9"), ("rare words only", "xx", "a"), ("others", "xx", "b"), ("\x00\x1f", "zz", "only")]
    return docs


def hash_of(x):
    return sum(map(ord, x or ""))


@pytest.mark.parametrize("least, k, rows, sums", [(10, 10, 1 << 16, 1 << 20), (1, 3, 7, 2)])
def test_against_all_groups_and_terms(spark, monkeypatch, least, k, rows, sums):
    monkeypatch.setattr(divergence, "ROWS", rows)
    monkeypatch.setattr(divergence, "SUMS", sums)
    monkeypatch.setattr(divergence, "FIRST", 1)
    docs = corpus()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "text string, lang string, source string, term string, p int").repartition(3)
    got = divergence.audit(frame, least, k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(docs, least, k)


def test_search_does_not_evaluate_all(spark, monkeypatch):
    """Buckets below the k-th value are left out."""
    rows = [("en", "s", f"t{i}", 1 << (i % 20), 1000 + (1 << (i % 20)) * 500, 1000) for i in range(2000)]
    kept = spark.createDataFrame(rows, "lang string, source string, term string, n long, p long, q long")
    evaluated = []
    plain_cut = divergence.cut
    monkeypatch.setattr(divergence, "cut", lambda df: evaluated.append(df) or plain_cut(df))
    got = divergence.distinctive_terms(kept, 10).collect()
    want = sorted(((-((p - q) ** 2 // (p + q)), t) for _, _, t, _, p, q in rows))[:10]
    assert sorted((-r.value, r.term) for r in got) == want
    assert len(evaluated) == 3  # the buckets, the best of one round, and none that wait


def test_empty_table_and_query(spark, tmp_path):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    docs = corpus(8, 300)
    spark.createDataFrame(docs, "text string, lang string, source string").withColumn("doc_id", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op11_divergence(spark, str(tmp_path)).collect())) == brute(docs, 10, 10)


def test_probabilities_are_exact(spark):
    rows = [(3 * 10**13, 10**14, 5 * 10**6), (0, 7, 3), (10**15, 10**15, 1), (0, 0, 0)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.probability(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) if v else None for c, n, v in rows]

"""Toxicity by held-out accuracy; decontamination against brute force."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pipelens.llm import decontam, toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ba de ki lo mu ne ro sa ti vu".split()) for _ in range(rng.randrange(1, 4)))
    bad = ["grimwort", "slagface", "vilething"]
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(words) // 50)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", "s", "ly"]))
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, toxic int, source string")
    known = spark.createDataFrame(labels + [(1, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, known)
    assert 0 < np.count_nonzero(weights) < 5000  # L1 leaves a short list
    got = {r.doc_id: r.s for r in toxicity.score(docs, weights, "s").collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.98
    clean = toxicity.reject(docs, weights)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if s < 0.7}


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    assert np.array_equal(toxicity.fit(docs, frame(labels)), toxicity.fit(docs.repartition(5), frame(flipped)))


def test_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (3, " \n "), (None, "x " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.score(docs, weights).collect()] == [0.5] * 5
    assert toxicity.score(docs.where("doc_id > 9"), weights).count() == 0
    assert toxicity.fit(docs.where("doc_id > 9"), none).any() == False  # noqa: E712


def test_rows_of_the_fit_have_a_bound(spark):
    rows, labels = corpus(300)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    few, all_ = toxicity.fit(docs, known, rows=60), toxicity.fit(docs, known, rows=10**6)
    assert np.count_nonzero(few) < np.count_nonzero(all_)


def plain_features(text):
    """Buckets of the different words, stems, pairs and skip-pairs of a text, with integers that wrap by hand."""
    whole = 2**64
    words = "".join(c for c in (text or "") if c not in ".,;:!?\"'()[]{}*#&%$|<>-_")
    words = "".join(c.lower() if c.isascii() else c for c in words).split()
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    pair, skip, stem = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    raw = list(h)
    for n in (4, 5):
        raw += [xxhash.xxh64_intdigest(w[:n], n) * stem % whole for w in words if len(w) > n]
    raw += [(a * pair % whole) ^ ((b + pair) % whole) for a, b in zip(h, h[1:])] + [(a * skip % whole) ^ ((b + skip) % whole) for a, b in zip(h, h[2:])]
    mixed = [((x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % whole) >> 24 for x in raw]
    return {0} | {x % (toxicity.BUCKETS - 1) + 1 for x in mixed}


def test_weights_and_scores_are_those_of_a_plain_ftrl(spark):
    rows, labels = corpus(150, seed=8)
    rows += [(900, None), (901, "shared id b"), (901, "shared id a")]
    labels += [(900, 1), (901, 0), (901, 1), (902, 1)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    y = {i: max(b for j, b in labels if j == i) for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    text = {i: min((t for j, t in rows if j == i and t is not None), default="") for i, _ in rows}
    order = {r.doc_id: r.o for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 7) AS o").collect()}
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return -(z[k] - math.copysign(toxicity.L1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    score = lambda keys: 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(map(weight, keys))))))
    examples = [(plain_features(text[i]), y[i]) for i in sorted((i for i in y if i in text), key=order.get)]
    for _ in range(toxicity.EPOCHS):
        for keys, label in examples:
            g = (score(keys) - label) * (toxicity.POSITIVE if label else 1.0)
            for k in keys:
                step = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA
                z[k], n[k] = z[k] + g - step * weight(k), n[k] + g * g
    weights = toxicity.fit(docs, known)
    assert {k: weights[k] for k in np.flatnonzero(weights)} == pytest.approx({k: weight(k) for k in list(z) if weight(k)}, rel=1e-7)
    scored = toxicity.score(docs, weights)
    assert scored.columns == ["doc_id", "text", "score"]
    for r in scored.collect():
        assert r.score == pytest.approx(score(plain_features(r.text)), rel=1e-7)


# ---------------------------------------------------------------- decontamination


def plain_hits(text, items, split=True):
    words = decontam.words_of((text or "").encode())
    shingles = {k: {tuple(words[a : a + k]) for a in range(len(words) - k + 1)} for k in range(1, 6)}
    out = []
    for i, t in items:
        own = decontam.words_of((t or "").encode())
        if not own:
            continue
        head, dot, _ = t.rstrip(" .\n\t\r").rpartition(". ")
        question = decontam.words_of((head + dot if split and dot else t).encode())
        for part in [own] + [question] * (len(question) >= 10):
            k = min(5, len(part))
            want = {tuple(part[a : a + 5]) for a in range(max(1, len(part) - 4))}
            if len(want & shingles[k]) / len(want) >= 0.8:
                out.append(i)
                break
    return out


def bench(rng, n):
    word = lambda: rng.choice(["the", "of", "and", "is"]) if rng.random() < 0.4 else "".join(rng.choice("ab ce di fo gu".split()) for _ in range(3)) + str(rng.randrange(50))
    return [(i, " ".join(word() for _ in range(rng.randrange(12, 60))).capitalize() + ". " + " ".join(word() for _ in range(4)) + ".") for i in range(n)], word


@pytest.mark.parametrize("n,shard", [(40, 512), (23, 10)])
def test_hits_are_those_of_brute_force(spark, monkeypatch, n, shard):
    monkeypatch.setattr(decontam, "SHARD", shard)
    rng = random.Random(n)
    items, word = bench(rng, n)
    rows = []
    for d in range(150):
        words = [word() for _ in range(rng.randrange(0, 900))]
        for _ in range(d % 3):
            own = rng.choice(items)[1].split()
            cut = rng.choice([0, 0, 2, len(own) // 2])  # whole, nearly whole, half
            own = own[cut:] if rng.random() < 0.5 else own[: len(own) - cut]
            if rng.random() < 0.3:
                own = [w.upper().rstrip(".") + "," for w in own]
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        rows.append((d, rng.choice([" ", "\n"]).join(words)))
    rows += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[1][1]), (903, "x " * 100_000 + items[2][1])]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, item_id int, overlap string")
    test_items = spark.createDataFrame(items + [(777, None), (778, " "), (779, "the")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.find(docs, test_items).collect()), key=repr)
    want = sorted(((d, i) for d, t in rows for i in plain_hits(t, items + [(779, "the")])), key=repr)
    assert got == want
    left = decontam.remove(docs, test_items)
    assert left.columns == docs.columns
    hit = {d for d, _ in want}
    assert sorted((repr(r.doc_id) for r in left.collect())) == sorted(repr(d) for d, _ in rows if d not in hit)


def test_question_and_answer_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 forty two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20", "forty two")], "item_id long, text string, answer string")
    r = decontam.find(docs, items, answer="answer").first()
    assert (r.question_overlap, r.overlap) == (1.0, 1.0)


def test_a_question_counts_alone_and_an_answer_does_not(spark):
    q, a = [f"q{j}" for j in range(40)], [f"a{j}" for j in range(30)]
    other = [f"o{j}" for j in range(30)]
    pair = lambda x, y: " ".join(x) + ". " + " ".join(y) + "."
    items = [(1, pair(q, a)), (2, pair(["s1", "s2", "s3"], ["t" + w for w in a]))]
    texts = {
        10: q,  # a question without its answer
        11: a,  # an answer alone
        12: q + a,
        13: q[:20] + other + q[20:],  # torn, 32 of 36 shingles
        14: q[:30],  # 26 of 36
        15: a + q[:12],
        16: ["s1", "s2", "s3"],  # too short a question
        17: ["s1", "s2", "s3"] + ["t" + w for w in a],
        18: other + q[3:38] + other,  # 31 of 36
    }
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(10, 1), (12, 1), (13, 1), (17, 2), (18, 1)} == {(d, i) for d, w in texts.items() for i in plain_hits(" ".join(w), items)}
    assert (got[10, 1].question_overlap, got[10, 1].answer_overlap) == (1.0, 0.0) and got[10, 1].overlap < 0.8
    left = decontam.remove(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {11, 14, 15, 16}


def test_questions_are_retrieved_whatever_their_answers_weigh(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("of the and is".split()) if rng.random() < 0.5 else f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40))) + ". " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    rows = []
    for d in range(200):
        own = rng.choice(items)[1].split(". ")[0].split()
        at = rng.randrange(len(own))
        if d % 3 == 1:
            own[at] = "changed"
        elif d % 3 == 2:
            own[at:at] = [word() for _ in range(9)]
        rows.append((d, " ".join([word() for _ in range(rng.randrange(30))] + own + [word() for _ in range(5)])))
    got = {tuple(r) for r in decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()}
    want = {(d, i) for d, t in rows for i in plain_hits(t, items)}
    assert got == want and len(want) > 60


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(docs, none).count() == 0 and decontam.remove(docs, none).count() == 1
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.find(docs.where("doc_id > 1"), items).count() == 0


def index_of(items):
    """An index built without Spark, over items of which the last sentence is no answer."""
    split = [(i, decontam.words_of(t.encode())) for i, t in items]
    split = [(i, w) for i, w in split if w]
    df = {w: sum(w in own for _, own in split) for _, words in split for w in words}
    return decontam.Index([(i, w, [], {x: df[x] for x in w}) for i, w in split], len(split), sum(len(w) for _, w in split) / len(split))


def test_pieces_that_lie_apart_and_lost_rare_words_are_found():
    filler = [f"f{j}" for j in range(400)]
    words = [f"w{j}" for j in range(60)]
    apart = words[:20] + filler + words[20:40] + filler + words[40:]
    common = [f"c{j % 5}x{j}" for j in range(31)]
    short = common + [f"rare{j}" for j in range(5)]
    others = [(10 + n, " ".join(common[n % 7 :])) for n in range(60)]
    items = [(1, " ".join(words)), (2, " ".join(short)), *others]
    index = index_of(items)
    for text in (" ".join(apart), " ".join(filler + short[:31] + filler)):
        assert sorted(h[0] for h in index.hits([decontam.words_of(text.encode())])[0]) == sorted(plain_hits(text, items, split=False))
    assert 1 in plain_hits(" ".join(apart), items) and 2 in plain_hits(" ".join(short[:31]), items)


@pytest.mark.parametrize("seed", range(6))
def test_recall_is_one_over_torn_items(seed):
    rng = random.Random(seed)
    items, word = bench(rng, 150)
    items += [(1000 + n, " ".join(word() for _ in range(n % 7 + 1))) for n in range(12)]
    index, texts = index_of(items), []
    for _ in range(400):
        own, out = rng.choice(items)[1].split(), []
        while own:  # torn in pieces, words lost and changed here and there
            n = rng.randrange(1, 40)
            piece, own = own[:n], own[n:]
            if rng.random() < 0.15:
                piece[rng.randrange(len(piece))] = rng.choice(["", word()])
            out += [word() for _ in range(rng.randrange(0, 300))] + [w for w in piece if w]
        texts.append(" ".join(out))
    got = [sorted(h[0] for h in x) for x in index.hits([decontam.words_of(t.encode()) for t in texts])]
    want = [sorted(plain_hits(t, items, split=False)) for t in texts]
    assert got == want and sum(map(len, want)) > 200

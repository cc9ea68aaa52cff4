"""SimHash against brute force: fingerprints, links of every allocation, components, deduplication."""

import random

import numpy as np
import pytest
import xxhash

from pipelens.llm import simhash


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_prints(rng, n, centers):
    base = [rng.getrandbits(64) for _ in range(centers)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bits,n,centers", [(0, 50, 5), (1, 200, 10), (3, 400, 20), (3, 300, 1), (8, 250, 10)])
def test_links_span_all_links(spark, bits, n, centers):
    prints = near_prints(random.Random(bits * 1000 + n), n, centers)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all(bin(prints[at[e.a]] ^ prints[at[e.b]]).count("1") == e.apart <= bits for e in edges)
    want = classes(n, [(i, j) for i in range(n) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= bits])
    assert classes(n, [(at[e.a], at[e.b]) for e in edges]) == want


def test_hot_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    test_links_span_all_links(spark, 3, 300, 1)


def test_allocation_covers_every_pair_and_is_unequal_where_it_pays():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64)
    sample &= ~np.uint64((1 << 20) - 1)  # twenty bits that say nothing
    for n in (10**3, 10**6, 10**9):
        groups, limits = simhash.allocate(sample, n, 3)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t + 1 for t in limits) == 4 and min(limits) >= -1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


TEXT = " ".join(f"w{i}" for i in range(200))


def rows_for_classes():
    rng = random.Random(5)
    texts = [TEXT, TEXT.upper(), TEXT.replace("w7 ", "v7 "), "", None, "one", "one two", "one two", "é" * 10, " ".join(f"q{rng.random()}" for _ in range(300)), "x " * 5000]
    texts += [" ".join(f"z{rng.randrange(40)}" for _ in range(60)) for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)] + [(0, TEXT), (None, "one")]


def test_query_against_brute_force(spark):
    rows = rows_for_classes()
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, "y", 2) for r in rows], "doc_id long, text string, fp int, root string, least int")).collect()
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    cls = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {c: min((rows[i][0] for i in range(len(rows)) if cls[i] == c and rows[i][0] is not None), default=None) for c in cls}
    want = sorted(((rows[i][0], f"{prints[i]:016x}", least[cls[i]]) for i in range(len(rows))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0


def jaccard(a, b):
    s, t = (set(simhash.features((x or "").encode(), 5)) for x in (a, b))
    return len(s & t) / len(s | t) if s | t else 1.0


def test_deduplicate_keeps_one_of_each_group_and_all_others(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((len(rows), " ".join(words), "en"))
        for _ in range(g % 4):  # a few words changed: a shingle similarity well above 0.8
            edited = list(words)
            for _ in range(4):
                edited[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(edited), "en"))
        if g % 3 == 0:
            rows.append((len(rows), " ".join(words), "de"))
        half = words[:150] + [f"h{rng.randrange(10**6)}" for _ in range(150)]
        rows.append((len(rows), " ".join(half), "fr"))  # far below 0.8
    rows += [(500, "", "x"), (501, None, "x"), (502, "short", "x"), (502, "short", "x"), (None, "short", "x"), (None, "lonely text", "x")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, p_fp int")
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    cls = classes(len(rows), linked)
    want = set()
    for c in set(cls):
        ids = [i for i in range(len(rows)) if cls[i] == c]
        best = min(ids, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        want.add(best)
    assert sorted(kept, key=repr) == sorted((rows[i][:2] for i in want), key=repr)


def test_similar_tree_spans_all_similar_pairs():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 5000, 80)).astype(np.uint64) for _ in range(6)]
    sets = [np.zeros(0, dtype=np.uint64)] * 3
    for b in base:
        for _ in range(30):
            drop = rng.random(len(b)) > 0.06
            sets.append(np.unique(np.concatenate((b[drop], rng.integers(10**6, 10**7, 3).astype(np.uint64)))))
    like = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = classes(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j])])
    links = simhash.similar_tree(sets, 0.8)
    assert classes(len(sets), links) == want and len(links) == len(sets) - len(set(want))


def test_deduplicate_finds_copies_with_a_passage_more_or_less(spark):
    rng = random.Random(21)
    header = [f"common{i}" for i in range(25)]  # in many texts, so that its shingles count as common
    texts = []
    for g in range(50):
        n = rng.randrange(60, 260)
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(n)]
        words = header + words if g % 3 == 0 else words
        share = rng.choice((0.81, 0.85, 0.9))
        more = round(len(words) * (1 / share - 1))
        new = [f"n{g}x{rng.randrange(10**6)}" for _ in range(more)]
        texts += [words, words + new if g % 2 else words[: round(len(words) * share) + 1]]
        texts.append(words[: len(words) // 2] + new)  # far below 0.8
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    prints = [simhash.fingerprint(t.encode(), 0) for _, t in rows]
    assert len(linked) >= 40 and any((prints[i] ^ prints[j]).bit_count() > 12 for i, j in linked)
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(classes(len(rows), linked)))


def test_sharing_pairs_hold_all_similar_pairs():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 900, rng.integers(1, 60))).astype(np.uint64) for _ in range(40)]
    sets = base + [np.unique(np.concatenate((b[: max(1, round(len(b) * 0.9))], rng.integers(900, 2000, len(b) // 12).astype(np.uint64)))) for b in base]
    common = (np.arange(0, 900, 3, dtype=np.uint64), np.arange(300) % 7 + 4)
    firsts = [simhash.prefix(s, 0.8, common) for s in sets]
    flat = [np.concatenate([np.full(len(f), v) for f, v in zip(firsts, values)]) for values in (range(len(sets)), range(len(sets)), map(len, sets))]
    at = np.concatenate([np.arange(len(f)) for f in firsts])
    found = {(int(a), int(b)) for part in simhash.sharing_pairs(np.concatenate(firsts), *flat, at, 0.8) for a, b in zip(part[0], part[1])}
    like = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if like(sets[i], sets[j])}
    assert len(want) > 15 and want <= found


def test_parities_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(0, 400)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64))))
        assert simhash.apart(simhash.parity(a), simhash.parity(b)) <= len(np.setxor1d(a, b))
    assert simhash.apart(simhash.parity(a), simhash.parity(a)) == 0


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_components_do_not_depend_on_the_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "STAR_EDGES", most)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2150)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    of = classes(2200, [e for e in edges if e[0] != e[1]])
    touched = {x for e in edges if e[0] != e[1] for x in e}
    least = {}
    for x in sorted(touched):
        least.setdefault(of[x], x)
    assert got == {x: least[of[x]] for x in touched}


def test_what_is_common_does_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    """Passages in one of twelve texts each are known as common, however few texts a small table is judged by."""
    monkeypatch.setattr(simhash, "SAMPLE_TEXTS", 20)
    rng = random.Random(12)
    passages = [" ".join(f"p{g}w{i}" for i in range(12)) for g in range(10)]
    rows = [(i, " ".join(f"t{rng.randrange(10**9)}" for _ in range(20)) + " " + (passages[i % 12] if i % 12 < 10 else "")) for i in range(1600)]
    e, n = simhash.common_shingles(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    held = dict(zip(e.tolist(), n.tolist()))
    want = {int(x) for p in passages for x in simhash._shingles(p.encode(), 5)}
    assert want == set(held) and list(held) == sorted(held) and all(c >= simhash.COMMON_TEXTS for c in held.values())
    none = simhash.common_shingles(spark.createDataFrame([], "doc_id long, text string"), 5)
    assert len(none[0]) == len(none[1]) == 0

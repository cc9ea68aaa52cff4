"""Spherical-cap filters against all pairs."""

import numpy as np
import pytest

from pipelens.llm import caps, queries

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, similarity=0.93):
    vectors = [np.array(v, dtype=float) if v is not None and all(x is not None for x in v) else None for _, v, _ in rows]
    sizes = [len(v) for v, (_, _, y) in zip(vectors, rows) if v is not None and y is not None and np.isfinite(v).all() and v.any()]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    fit = [v is not None and len(v) == dim and np.isfinite(v).all() and v.any() and y is not None for v, (_, _, y) in zip(vectors, rows)]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and vectors[i] @ vectors[j] / np.sqrt((vectors[i] @ vectors[i]) * (vectors[j] @ vectors[j])) >= similarity:
                links[i].append(j)
                links[j].append(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            reach, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in reach:
                        reach.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(reach, least)
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def vectors(rng, n, dim):
    """Groups about centres, with neighbours on both sides of the threshold."""
    rows = []
    centres = rng.standard_normal((max(2, n // 25), dim))
    for i in range(n):
        noise = rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3, 1.0])
        rows.append((i, [float(x) for x in (centres[i % len(centres)] + noise).astype(np.float32)], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("dim", [1, 3, 20, 64])
def test_all_links_are_found(spark, dim):
    rows = vectors(np.random.default_rng(dim), 500, dim)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = caps.near_duplicates(frame)
    assert got.columns == ["vec_id", "label", "n_links", "component_id", "kept"]
    found, want = sorted(((r[0], *r[2:]) for r in got.collect()), key=repr), brute(rows)
    near = sum(w[1] for w in want)
    assert near > 100 and sum(f[1] for f in found) >= 0.99 * near
    assert all(f[1] <= w[1] for f, w in zip(found, want)) and (dim == 1 or found == want)


def test_hot_filters_copies_and_odd_rows(spark, monkeypatch, tmp_path):
    """Filters of many cells, one vector and one group of near copies that hold most rows, nulls and repeats."""
    monkeypatch.setattr(caps, "CELL", 16)
    rng = np.random.default_rng(9)
    rows = vectors(rng, 200, 16)
    centre = rng.standard_normal(16)
    rows += [(1000 + i, [float(x) for x in centre.astype(np.float32)], 1) for i in range(120)]
    rows += [(2000 + i, [float(x) for x in (centre + rng.standard_normal(16) * 0.05).astype(np.float32)], 1) for i in range(120)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] * 16, 1), (3004, [1.0] * 15, 1), (3005, [float("inf")] * 16, 1)]
    rows += [(3006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (rows[0][0], rows[0][1], rows[0][2]), (3007, [x * 3.0 for x in rows[0][1]], rows[0][2]), (3008, [], 1), (3009, [0.0] * 15 + [1.0], 7), (3010, [-0.0] * 15 + [1.0], 7)]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op13_caps(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    assert max(w[1] for w in got) >= 239


def test_tables_without_links(spark):
    assert caps.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (None, [1.0], None)]
    got = caps.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == brute(rows)


def test_filters_share_what_is_expected():
    """Pairs at the threshold share COMMON directions on average, and hardly any pair shares none."""
    rng = np.random.default_rng(1)
    filters = caps.Filters(5000, 64, 0.93)
    u, w = rng.standard_normal((2, 1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    common = [0] * 1500
    sides = [set(zip(*(x.tolist() for x in filters.decoded(side)))) for side in (u, v)]
    for row, _ in sides[0] & sides[1]:
        common[row] += 1
    assert 0.8 * caps.COMMON < np.mean(common) < 1.3 * caps.COMMON and sum(c == 0 for c in common) <= 3


def test_list_decoding_finds_all_directions():
    filters = caps.Filters(200, 16, 0.9)
    u = np.random.default_rng(3).standard_normal((40, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = set(zip(*(x.tolist() for x in filters.decoded(u))))
    want = set()
    for turn in range(caps.TURNS):
        score = np.einsum("nmd,mbd->nmb", filters.rotated(u, turn).reshape(40, filters.blocks, -1), filters.code[turn])
        for i in range(40):
            for a in range(filters.codes):
                for b in range(filters.codes):
                    if score[i, 0, a] + score[i, 1, b] >= filters.height * np.sqrt(2):
                        want.add((i, turn * filters.codes**2 + a * filters.codes + b))
    assert filters.blocks == 2 and got == want

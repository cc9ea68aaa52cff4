"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def cosine(a, b):
    dot = na = nb = 0.0
    for x, y in zip(a, b):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return dot / (np.sqrt(na) * np.sqrt(nb))


def usable(v, dim):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, dim, mod, k):
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and usable(v, dim)]
    out = []
    for q, v in {i: max(w for j, w in good if j == i) for i, _ in good if i % mod == 0}.items():
        best = sorted((-cosine(v, w), i) for i, w in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def rows_of(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]
    hot = rows[1][1]
    rows += [(n + i, hot) for i in range(n // 2)] + [(2 * n + i, [2 * x for x in hot]) for i in range(5)]
    rows += [(3 * n, None), (3 * n + 1, [0.0] * dim), (3 * n + 2, [float("nan")] + [1.0] * (dim - 1)), (3 * n + 3, [None] + [1.0] * (dim - 1)), (3 * n + 4, [float("inf")] + [1.0] * (dim - 1))]
    rows += [(3 * n + 5, [1.0] * (dim - 1)), (None, hot), (0, rows[0][1]), (3 * n + 10, [1e-30 * x for x in hot]), (3 * n + 11, [1e30 * x for x in hot]), (3 * n + 12, [])]
    return rows


@pytest.mark.parametrize("n,dim,mod,k,block", [(120, 16, 10, 5, 8192), (80, 3, 7, 4, 5), (60, 64, 1, 3, 16)])
def test_nearest_is_exact(spark, monkeypatch, n, dim, mod, k, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    rows = rows_of(n, dim, n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % mod == 0, k).collect()))
    want = brute(rows, dim, mod, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(200, 32)), rng.standard_cauchy(size=(300, 32))
    a8, sa, la, ea = ann.quantised(a)
    b8, sb, lb, eb = ann.quantised(b)
    about = (a8.astype(float) @ b8.astype(float).T) * sa[:, None] * sb[None, :]
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert (np.abs(true - about) <= eb[None, :] + ea[:, None] * lb[None, :] + 1e-9).all()


def test_fewer_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [0.0, 1.0], 1, "")], SCHEMA)
    assert [tuple(r) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(df, F.col("vec_id") == 9).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("repeats", [2, 4, 30])
def test_rows_of_the_querys_own_id_take_no_place_of_others(repeats):
    lost = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        rows = rng.normal(size=(120, 16))
        rows[:repeats] = rows[0] + 1e-3 * rng.normal(size=(repeats, 16))
        ids = np.arange(120)
        ids[:repeats] = 0
        ask, all_ = ann.Block(np.array([0]), rows[:1]), ann.Block(ids, rows)
        _, at = ann.survivors(ask, all_, slice(0, 1), np.array([-np.inf]), 5)
        true = rows @ rows[0] / np.linalg.norm(rows, axis=1)
        best = sorted((-true[i], i) for i in range(repeats, 120))[:5]
        lost += len({i for _, i in best} - set(at.tolist()))
        assert not set(at.tolist()) & set(range(repeats))
    assert lost == 0


def test_repeated_ids_extreme_components_and_odd_lengths(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i) % 40, (v * 10.0 ** float(e)).tolist()) for i, (v, e) in enumerate(zip(rng.normal(size=(160, 8)), rng.choice([-300, -200, -160, 0, 160, 200, 300], 160)))]
    odd = [(5, [1.0] * 30), (7, [float("nan")] * 30), (8, [None] * 9), (8, [0.0] * 9)]  # longer, usable or not
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)

    def unit(v):
        v = [x / max(map(abs, v)) for x in v]
        return [x / sum(y * y for y in v) ** 0.5 for x in v]

    own = {q: max(v for i, v in rows if i == q) for q in range(0, 40, 4)}
    got = {(r.query_id, r["rank"]): r.score for r in ann.nearest(df, F.col("vec_id") % 4 == 0).collect()}
    for q, v in own.items():
        want = sorted((-sum(a * b for a, b in zip(unit(v), unit(w))), i) for i, w in rows if i != q)[:5]
        assert [got[q, r] for r in range(1, 6)] == pytest.approx([-s for s, _ in want], abs=1e-12)
    assert len(got) == 50

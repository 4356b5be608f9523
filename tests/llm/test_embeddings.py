from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from rankmesh.llm import embeddings as E


def brute(ids, x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    low = dict(enumerate(ids))
    moved = True
    while moved:
        moved = False
        for i, j in np.argwhere(close):
            if low[j] < low[i]:
                low[i], moved = low[j], True
    return {v: (int(close[i].sum()), low[i]) for i, v in enumerate(ids)}


def vectors(n: int, seed: int):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (n, 16))
    near = base[: n // 4] + rng.normal(0, 0.02, (n // 4, 16))
    dense = base[0] + rng.normal(0, 0.02, (60, 16))  # a large group
    same = base[:5]
    return np.concatenate([base, near, dense, same]).astype(np.float32)


@pytest.mark.parametrize(("cell", "wide"), [(1024, E.WIDE), (16, E.WIDE), (16, 0)])
def test_links_against_brute_force(spark, cell, wide):
    x = vectors(400, 1)
    rows = [(3 * i, v.tolist(), 0, "clash", "clash") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.linked(df, cell=cell, wide_bytes=wide).collect()}
    want = brute([r[0] for r in rows], x.astype(np.float64))
    assert len(got) == len(rows)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert 0.97 * there <= found <= there
    assert all(got[i][0] <= want[i][0] for i in got) and sum(got[i][:2] == want[i] for i in got) >= 0.97 * len(got)
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def at_threshold(n: int, dim: int, seed: int, common: float = 0.0) -> np.ndarray:
    """n pairs of unit vectors, each at a cosine of 0.9000001, all of them with a direction in common; nothing else links."""
    rng = np.random.default_rng(seed)

    def other(x):
        y = rng.normal(0, 1, x.shape)
        y[:, 0] = 0 if common else y[:, 0]
        y -= (y * x).sum(1)[:, None] * x
        return y / np.linalg.norm(y, axis=1)[:, None]

    a = rng.normal(0, 1, (n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    a[:, 0] += common
    a /= np.linalg.norm(a, axis=1)[:, None]
    return np.stack([a, 0.9000001 * a + np.sqrt(1 - 0.9000001**2) * other(a)], 1).reshape(2 * n, dim)


@pytest.mark.parametrize(("common", "wide"), [(0.0, E.WIDE), (1.5, E.WIDE), (1.5, 0)])
def test_recall_at_the_very_threshold_from_end_to_end(spark, common, wide):
    x = at_threshold(3000, 64, 2, common)
    assert common == 0 or (x[::2] @ x[::2].T).mean() > 0.6
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}))
    got = {r.vec_id: r for r in E.linked(df, cell=128, wide_bytes=wide).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    there = int((np.triu(u @ u.T >= 0.9, 1)).sum())
    found = sum(r.n_links for r in got.values()) // 2
    assert 0.95 * there <= found <= there


@pytest.mark.parametrize("wide", [E.WIDE, 0])
def test_crowded_cells_are_split_from_their_own_mean(spark, monkeypatch, wide):
    """Most vectors lie in two tight regions, which no plane through the mean of all divides: the links are still found, within parts."""
    rng = np.random.default_rng(11)
    directions = np.linalg.qr(rng.normal(0, 1, (32, 32)))[0]
    x = np.concatenate([directions[0] + 0.11 * rng.normal(0, 1, (2500, 32)), directions[1] + 0.11 * rng.normal(0, 1, (2500, 32)), rng.normal(0, 1, (1000, 32))])
    x = np.concatenate([x, x[::10] + 0.01 * rng.normal(0, 1, x[::10].shape)])
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))}))
    called, split = [], E._split
    monkeypatch.setattr(E, "_split", lambda *a: (called.append(1), split(*a))[1])
    got = {r.vec_id: r for r in E.linked(df, cell=64, wide_bytes=wide).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(r.n_links for r in got.values())
    assert called and 0.95 * close.sum() <= found <= close.sum() and all(got[i].n_links <= close[i].sum() for i in got)
    assert all(got[len(x) - 600 + k].component_id == got[10 * k].component_id for k in range(600))


def test_a_common_direction_crowds_no_cell():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40_000, 64))
    x[:, 0] += 12
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (x[:500] @ x[500:1000].T).mean() > 0.6
    centre = x.mean(0)
    r = np.linalg.norm(x - centre, axis=1)
    signs, tables = E.tables_for(len(x), spread=r, counts=np.ones(len(r)))
    own = E.cells(x, centre, signs, tables)
    pairs = sum((np.bincount(own[:, t], minlength=1 << signs).astype(float) ** 2).sum() for t in range(tables))
    plain = E.cells(x, 0.0, signs, tables)
    assert np.bincount(own[:, 0]).max() < 4 * E.CELL and np.bincount(plain[:, 0]).max() > 4 * E.CELL
    assert pairs < 2.5 * tables * len(x) ** 2 / 2**signs


def test_the_least_work_is_taken():
    assert E.tables_for(100) == (0, 1)
    signs, tables = E.tables_for(10**6)
    assert signs >= 8 and tables < 30
    # all within the threshold of their mean: cells can't tell them apart, so all pairs are met at once
    assert E.tables_for(50_000, spread=np.array([0.3]), counts=np.ones(1)) == (0, 1)


def test_pairs_at_the_threshold_collide():
    x = at_threshold(3000, 64, 5)
    a, b, found = x[::2], x[1::2], 0
    for k in range(0, 3000, 500):
        i, j = E.near(a[k : k + 500], b[k : k + 500])
        found += (i == j).sum()
    assert found / 3000 >= 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1e-300, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [2.0, 0.1]), (10, [1e300, 1e299]), (11, [-1.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.linked(df).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11)] + [(7, 4, 7, True)] * 2 + [(8, 4, 7, False), (0, 4, 7, False), (10, 4, 7, False)]
    assert got == sorted(want, key=str)
    assert E.linked(df.limit(0)).count() == 0

"""Delay embedding, principal components and spanning trees against numpy, with small blocks and several rounds."""

import numpy as np
import pytest

from gapmend.operators.features import topology


def prim(p):
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    left, near, out = set(range(1, len(p))), d[0].copy(), []
    while left:
        j = min(left, key=lambda x: near[x])
        out.append(near[j])
        left.remove(j)
        near = np.minimum(near, d[j])
    return np.array(out)


def table(spark, clouds):
    rows = [("d", i, j, [float(x) for x in q]) for i, p in clouds.items() for j, q in enumerate(p)]
    return spark.createDataFrame(rows, "dataset string, series_id bigint, point bigint, coords array<double>").repartition(3)


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=(70, 3)), axis=0)
    apart = np.concatenate([rng.normal(size=(30, 3)), 100 + rng.normal(size=(30, 3))])
    return {1: walk, 2: apart, 3: rng.integers(0, 3, size=(60, 2)).astype(float), 4: walk[:1], 5: np.zeros((20, 3)),
            6: walk[:5], 7: np.array([[0.0], [2.0], [1.0], [4.0]] * 9)}


@pytest.mark.parametrize("steps", [4, 25, 256])
def test_tree(spark, clouds, monkeypatch, steps):
    monkeypatch.setattr(topology, "POINTS", steps)
    got = {}
    for r in topology.spanning_tree(table(spark, clouds)).collect():
        got.setdefault(r["series_id"], []).append((r["u"], r["v"], r["w"]))
    for i, p in clouds.items():
        edges = got.get(i, [])
        assert len(edges) == len(p) - 1
        assert np.allclose(sorted(w for *_, w in edges), sorted(prim(p)), atol=1e-12)
        assert all(w == pytest.approx(np.linalg.norm(p[u] - p[v]), abs=1e-12) for u, v, w in edges)
        # n - 1 edges that reach every point
        part = list(range(len(p)))
        for u, v, _ in edges:
            part = [part[u] if x == part[v] else x for x in part]
        assert len(set(part)) == 1


@pytest.mark.parametrize("steps", [4, 256])
def test_entropy(spark, clouds, monkeypatch, steps):
    monkeypatch.setattr(topology, "POINTS", steps)
    got = {r["series_id"]: r["value"] for r in topology.persistence_entropy_h0(table(spark, clouds)).collect()}
    assert set(got) == set(clouds)
    for i, p in clouds.items():
        life = prim(p)
        life = life[life > 0]
        if not len(life):
            assert got[i] == topology.UNDEFINED
        else:
            q = life / life.sum()
            assert got[i] == pytest.approx(-(q * np.log2(q)).sum() / np.log2(life.sum()), abs=1e-9)


def test_far_blocks_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(topology, "POINTS", 10)
    line = np.arange(400.0)[:, None]
    edges = topology._tree_edges(table(spark, {1: line}))
    # a tree per block and one edge to the next block: nothing else is near enough
    assert edges.count() == 40 * 9 + 39


def test_embedding_and_axes(spark):
    rng = np.random.default_rng(6)
    data = {1: rng.normal(size=1600), 2: np.cumsum(rng.normal(size=200)), 3: rng.normal(size=5), 4: rng.normal(size=2), 5: np.ones(1)}
    rows = [("d", i, t, float(v)) for i, x in data.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double").repartition(3)
    points = topology.takens_embedding(df)
    have, low = {}, {}
    for r in points.collect():
        have.setdefault(r["series_id"], {})[r["point"]] = r["coords"]
    for r in topology.embedding_pca(points).collect():
        low.setdefault(r["series_id"], {})[r["point"]] = r["coords"]
    for i, x in data.items():
        n = len(x)
        delay = max(min(30, n // 3), 1)
        dim = max(min(50, n // delay), 2)
        want = np.array([x[s:s + (dim - 1) * delay + 1:delay] for s in range(0, n - (dim - 1) * delay, 10)])
        assert sorted(have.get(i, {})) == list(range(len(want)))
        if not len(want):
            continue
        assert np.array_equal(np.array([have[i][j] for j in range(len(want))]), want)
        c = want - want.mean(axis=0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        k = min(3, *want.shape)
        got = np.array([low[i][j] for j in range(len(want))])
        assert got.shape == (len(want), k)
        best = u[:, :k] * s[:k]
        assert np.allclose(got @ got.T, best @ best.T, atol=1e-7)

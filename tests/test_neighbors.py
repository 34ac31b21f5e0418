"""Neighbour search: matrix products against plain differences, and how often a query is sent."""

import numpy as np
import pytest

from gapmend.operators import neighbors as N


@pytest.fixture
def points():
    """Points far from the origin, with copies, and queries among and beside them."""
    rng = np.random.default_rng(1)
    t = rng.normal(size=(400, 3)) + 1000
    t[50:90] = t[7]
    q = np.r_[t[:60], rng.normal(size=(40, 3)) + 1000]
    return q, t, rng.permutation(400), np.round(np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2)), 9)


@pytest.mark.parametrize("k", [1, 5, 150])
def test_nearest(points, monkeypatch, k):
    monkeypatch.setattr(N, "PAIRS", 4000)
    q, t, nid, d = points
    row, at, dist = N._nearest(q, t, nid, k)
    for i in range(len(q)):
        order = np.lexsort((nid, d[i]))[:k]
        assert (at[row == i] == order).all() and (dist[row == i] == d[i][order]).all()


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_tally(points, monkeypatch, share):
    monkeypatch.setattr(N, "PAIRS", 4000)
    q, t, _, d = points
    radius, code = float(np.quantile(d, share)), np.arange(len(t)) % 4
    got = {(a, c): rest for a, c, *rest in zip(*N._tally(q, t, code, radius))}
    want = {}
    for i in range(len(q)):
        for c in range(4):
            x = d[i][(code == c) & (d[i] <= radius)]
            if len(x):
                want[i, c] = [len(x), (x == 0).sum(), pytest.approx((1 / x[x > 0]).sum(), rel=1e-7)]
    assert got == want


def test_query_is_sent_once_per_bin(spark, monkeypatch):
    """In many dimensions every cell matters; copies of a query follow the bins, not the cells, and leave in small batches."""
    monkeypatch.setattr(N, "CELL_ROWS", 4)
    monkeypatch.setattr(N, "BUCKET", 200)
    monkeypatch.setattr(N, "ROUTED", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=40)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    left, _ = N._plan(df, df, 5, None)
    sent = left.count()
    assert sum(r["count"] for r in sent.collect()) <= 4 * len(rows)
    near = {r["id"]: [x["nid"] for x in r["near"]] for r in N.knn_join(df, df, 5).collect()}
    x = np.array([v for _, v in rows])
    for i in range(400):
        assert near[i] == list(np.lexsort((np.arange(400), np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)))[:5])

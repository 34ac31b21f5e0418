"""Clustering shares what its runs and clusters have in common, with the results of plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.operators import cluster as C, correlate as R
from test_cluster_brute import best_shift, gain, merged, plain_kshape, ratio, walks, z  # noqa: F401


@pytest.mark.parametrize("m", [1, 2, 21, 22, 83, 300])
def test_products_at_all_shifts(m):
    """Matrix products and transforms give the correlations of every pair."""
    rng = np.random.default_rng(m)
    a, b = rng.normal(size=(13, m)), rng.normal(size=(700, m))
    a[3] = 0
    one, two = R.Spectra(a), R.Spectra(b)
    table = one.best(two)
    i, j = rng.integers(13, size=60), rng.integers(700, size=60)
    assert table[i, j] == pytest.approx([best_shift(a[x], b[y]) for x, y in zip(i, j)], abs=1e-12)
    value, shift = one.pairs(i, two, j)
    assert value == pytest.approx(table[i, j], abs=1e-12)
    assert [int(np.correlate(b[y], a[x], "full").argmax()) - (m - 1) for x, y in zip(i, j) if x != 3] == list(shift[i != 3])
    assert np.abs(two.best(one).T - table).max() < 1e-12


def test_kshape_of_a_task_keeps_no_table(monkeypatch):
    """Labels do not depend on how many pairs a task holds; equal, constant and single series count too."""
    monkeypatch.setattr(C, "PAIR_TABLE", 40)
    rng = np.random.default_rng(8)
    for rep in range(12):
        n, m = int(rng.integers(6, 30)), int(rng.integers(6, 40))
        k, ids = int(rng.integers(1, n + 1)), np.sort(rng.choice(1000, n, replace=False))
        rows = np.array([z(np.cumsum(rng.normal(size=m))) for _ in range(n)])
        rows[0], rows[1] = 0, rows[2]
        labels, done = C._kshape_block(ids, rows, k, rep, 200)
        assert done and list(labels) == plain_kshape(list(ids), list(rows), k, rep)


def test_centroid_of_few_members():
    """Few members give the eigenvector of their outer products without a matrix over time."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        y, old = rng.normal(size=(n, 30)), rng.normal(size=30)
        assert C._next_centroid(y, old) == pytest.approx(C._centroid(C._part(y, old), old), abs=1e-9)


def test_runs_of_a_data_set_share_its_series(walks, monkeypatch):
    """Five runs in two tasks, and in rounds over blocks, are the runs of a loop."""
    df, data = walks
    monkeypatch.setattr(C, "COPIES", 2)
    plan = df.select("dataset").distinct().withColumn("k", F.explode(F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint")))).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(3))))

    def found():
        out = {}
        for r in C._runs(df, plan, 100).collect():
            out.setdefault((r.dataset, r.run_k, r.run_seed), {})[r.series_id] = r.cluster_id
        return out

    want = {}
    for ds, k, seed in itertools.product("ab", (2, 3), (0, 3)):
        ids = sorted(i for d, i in data if d == ds)
        want[ds, k, seed] = dict(zip(ids, plain_kshape(ids, [z(data[ds, i]) for i in ids], k, seed)))
    with monkeypatch.context() as m:
        m.setattr(C, "kshape", None)  # one copy of the series for a task's runs, not one for each run
        assert found() == want
    monkeypatch.setattr(C, "BLOCK_VALUES", 160)
    assert found() == want


@pytest.mark.parametrize("weight", [10**9, -10**9])
def test_run_scores(spark, walks, monkeypatch, weight):
    """A pair is compared once for all runs, or in each cluster; the scores are those of a loop."""
    df, data = walks
    monkeypatch.setattr(C, "GROUP_PAIRS", weight)
    monkeypatch.setattr(R, "BLOCK", 1)
    if weight > 0:
        monkeypatch.setattr(C, "mean_ncc_arrays", lambda arr, keys: R.mean_ncc_arrays(arr.where("false"), keys))
    rows = [(d, k, s, i, (i // (3 + s)) % k) for (d, i) in data for k in (2, 3) for s in (0, 1)]
    rows += [(d, 4, 0, i, int(i == 10)) for d, i in data]  # a lone series
    runs = spark.createDataFrame(rows, "dataset string, run_k bigint, run_seed int, series_id bigint, cluster_id bigint")
    got = {(r.dataset, r.run_k, r.run_seed): (r.score, r.n_clusters) for r in C.run_scores(df, runs).collect()}
    assert len(got) == 10
    for key, (score, n) in got.items():
        groups = {}
        for d, k, s, i, c in rows:
            if (d, k, s) == key:
                groups.setdefault(c, []).append(data[d, i])
        lone = min(map(len, groups.values())) < 2
        want = 0 if lone else np.mean([np.mean([best_shift(x, y) for x, y in itertools.combinations(g, 2)]) for g in groups.values()])
        assert n == len(groups) and score == pytest.approx(want, abs=1e-9)


def test_half_pairs_meet_once(spark):
    """Every unordered pair of blocks is one task, not both of its orders."""
    import pandas as pd
    rows = spark.createDataFrame([("d", i, [float(i), 1.0]) for i in range(40)], "dataset string, bid bigint, vals array<double>")

    def pairs(key, a, b):
        ok = (a["bid"].to_numpy()[:, None] < b["bid"].to_numpy()[None, :]) if key[-2] == key[-1] else np.ones((len(a), len(b)), bool)
        i, j = np.nonzero(ok)
        one, two = a["bid"].to_numpy()[i], b["bid"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    old, R.BLOCK = R.BLOCK, 1
    try:
        got = [(r.a, r.b) for r in R.half_pairs(rows, ["dataset"], pairs, "a bigint, b bigint").collect()]
    finally:
        R.BLOCK = old
    assert sorted(got) == list(itertools.combinations(range(40), 2))


@pytest.mark.parametrize("rule", ["gain", "ratio"])
@pytest.mark.parametrize("where", ["task", "rounds"])
def test_merges_in_a_task_and_in_rounds(spark, walks, monkeypatch, rule, where):
    """A data set of few clusters merges without a Spark job per round; both forms reach the same clusters."""
    df, data = walks
    monkeypatch.setattr(C, "_merge_large" if where == "task" else "_merge_block", None)
    monkeypatch.setattr(C, "MERGE_CLUSTERS", 100 if where == "task" else 1)
    start = {(d, i): i // 6 for d, i in data}
    table = spark.createDataFrame([(d, i, c) for (d, i), c in start.items()], "dataset string, series_id bigint, cluster_id bigint")
    got = C.merge_clusters(df, table, 0.3, far=-2.0) if rule == "gain" else C.merge_clusters_ratio(df, table, 0.3)
    want = {ds: merged(data, ds, start, 0.3, gain if rule == "gain" else ratio) for ds in "ab"}
    assert {(r.dataset, r.series_id): r.cluster_id for r in got.collect()} == {(d, i): want[d][c] for (d, i), c in start.items()}

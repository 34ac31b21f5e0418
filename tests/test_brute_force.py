"""Operators without SQL against direct numpy definitions on small series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.operators import blocks, impute as I
from gapmend.operators.features import acf, catch22, decomp, entropy, topology


def values(df):
    return {(r["dataset"], r["series_id"], r["feature"]): r["value"] for r in df.collect()}


def ols(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, float(((y - x @ beta) ** 2).sum())


@pytest.mark.parametrize("steps", [4096, 30])
def test_ar(series, monkeypatch, steps):
    monkeypatch.setattr(blocks, "STEPS", steps)
    df, data = series
    got = values(acf.ar(df))
    for (ds, i), x in data.items():
        rows = np.stack([np.ones(80)] + [x[10 - k:90 - k] for k in range(1, 11)], axis=1)
        assert got[ds, i, "ar_coefficient__coeff_10__k_10"] == pytest.approx(ols(x[10:], rows)[0][10], abs=1e-8)


def adf_direct(x, top):
    d = np.diff(x)

    def fit(p, start):
        t = np.arange(start, len(d))
        m = np.stack([np.ones(len(t)), x[t]] + [d[t - k] for k in range(1, p + 1)], axis=1)
        return d[t], m
    best = None
    for p in range(top + 1):
        y, m = fit(p, top)
        rss = ols(y, m)[1]
        aic = len(y) * np.log(rss / len(y)) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p)
    p = best[1]
    y, m = fit(p, p)
    beta, rss = ols(y, m)
    se = np.sqrt(rss / (len(y) - p - 2) * np.linalg.inv(m.T @ m)[1, 1])
    return beta[1] / se, p


@pytest.mark.parametrize("steps", [4096, 30])
def test_adf(series, monkeypatch, steps):
    monkeypatch.setattr(blocks, "STEPS", steps)
    df, data = series
    got = values(acf.adf(df, 90))
    for (ds, i), x in data.items():
        stat, lag = adf_direct(x - x.mean(), acf.adf_max_lag(90))
        assert got[ds, i, 'augmented_dickey_fuller__attr_"usedlag"__autolag_"AIC"'] == lag
        assert got[ds, i, 'augmented_dickey_fuller__attr_"teststat"__autolag_"AIC"'] == pytest.approx(stat, abs=1e-7)


def test_lempel_ziv(series):
    df, data = series
    got = values(entropy.lempel_ziv(df))
    for (ds, i), x in data.items():
        for b in entropy.LZ_BINS:
            seq = np.searchsorted(np.linspace(x.min(), x.max(), b + 1)[1:], x, side="left")
            words, at, size = set(), 0, 1
            while at + size <= len(seq):
                w = tuple(seq[at:at + size])
                if w in words:
                    size += 1
                else:
                    words.add(w)
                    at, size = at + size, 1
            assert got[ds, i, f"lempel_ziv_complexity__bins_{b}"] == pytest.approx(len(words) / len(seq))


def test_heterogeneity(series):
    df, data = series
    got = values(decomp.heterogeneity(df))
    for (ds, i), x in data.items():
        s = ((x - x.mean()) / x.std()) ** 2
        m = np.stack([np.ones(86)] + [s[4 - k:90 - k] for k in range(1, 5)], axis=1)
        rss = ols(s[4:], m)[1]
        assert got[ds, i, "heterogeneity"] == pytest.approx(1 - rss / ((s[4:] - s[4:].mean()) ** 2).sum(), abs=1e-7)


def test_embedding_fit(series):
    df, _ = series
    v = [r["value"] for r in catch22.embedding_fit(df).collect()]
    assert len(v) == 6 and all(0 <= x < 10 for x in v)


@pytest.mark.parametrize("steps", [4096, 50, 7])
def test_lag_sums(spark, monkeypatch, steps):
    monkeypatch.setattr(blocks, "STEPS", steps)
    rng = np.random.default_rng(12)
    data = {n: rng.normal(size=n) for n in (1, 2, 3, 49, 50, 51, 230)}
    rows = [("a", n, t, n, float(v)) for n, x in data.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, n bigint, y double")
    got = {(r["series_id"], r["lag"]): r["s"] for r in catch22.lag_sums(df, F.ceil(F.col("n") / 3)).collect()}
    for n, x in data.items():
        for k in range(1, -(-n // 3) + 1):
            if k < n:
                assert got.pop((n, k)) == pytest.approx((x[:-k] * x[k:]).sum(), abs=1e-9)
    assert all(k >= n for n, k in got)


def residuals(y, x):
    return y - np.polyval(np.polyfit(x, y, 1), x)


def fluctuation_direct(x, lag, ranged):
    taus = catch22.fluctuation_scales(len(x))
    if len(x) < 10 or len(taus) < 12:
        return 0.0
    cs = np.cumsum(x[::lag][:len(x) // lag])
    f = []
    for tau in taus:
        res = [residuals(cs[i * tau:(i + 1) * tau], np.arange(tau)) for i in range(len(cs) // tau)]
        f.append(np.sqrt(np.mean([np.ptp(r) ** 2 for r in res]) if ranged else np.mean(np.square(res))))
    lt, lf = np.log(taus), np.log(f)
    err = [np.linalg.norm(residuals(lf[:i], lt[:i])) + np.linalg.norm(residuals(lf[i - 1:], lt[i - 1:])) for i in range(6, len(taus) - 5)]
    return (int(np.argmin(np.round(err, 9))) + 6) / len(taus)


@pytest.mark.parametrize("steps", [4096, 50, 7])
def test_fluctuation(spark, monkeypatch, steps):
    monkeypatch.setattr(blocks, "STEPS", steps)
    rng = np.random.default_rng(11)
    data = {i: rng.normal(size=n) if i % 2 else np.cumsum(rng.normal(size=n)) for i, n in enumerate((5, 20, 64, 99, 300, 401))}
    rows = [("a", i, t, float(v)) for i, x in data.items() for t, v in enumerate(x)]
    got = values(catch22.fluctuation(spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double")))
    for i, x in data.items():
        assert got["a", i, "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1"] == pytest.approx(fluctuation_direct(x, 1, True))
        assert got["a", i, "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1"] == pytest.approx(fluctuation_direct(x, 2, False))


def test_topology(series):
    df, data = series
    pts = {}
    for r in topology.embedding_pca(topology.takens_embedding(df)).collect():
        pts.setdefault((r["dataset"], r["series_id"]), []).append((r["point"], r["coords"]))
    ent = values(topology.topology(df))
    for (ds, i), x in data.items():
        emb = np.array([x[s:s + 90:30][:3] for s in range(0, 90 - 60, 10)])
        proj = np.array([c for _, c in sorted(pts[ds, i])])
        c = emb - emb.mean(axis=0)
        # a projection on all axes that carry variance keeps every distance
        want = np.linalg.norm(c[:, None] - c[None], axis=2)
        have = np.linalg.norm(proj[:, None] - proj[None], axis=2)
        assert np.allclose(want, have, atol=1e-8)
        # minimum spanning tree by exhaustive growth
        left, tree, cur = set(range(1, len(emb))), [], {0}
        while left:
            d, j = min((want[a, b], b) for a in cur for b in left)
            tree.append(d)
            cur.add(j)
            left.remove(j)
        p = np.array(tree) / sum(tree)
        assert ent[ds, i, "persistence_entropy_h0"] == pytest.approx(-(p * np.log2(p)).sum() / np.log2(sum(tree)), abs=1e-8)


@pytest.fixture(scope="module")
def factor_cluster(spark):
    """One cluster of eight series that share two factors."""
    rng = np.random.default_rng(5)
    t = np.arange(60)
    base = np.stack([np.sin(t / 5), np.cos(t / 9)])
    x = rng.normal(size=(8, 2)) @ base + 5
    rows = [("d", 0, i, int(s), float(x[i, s])) for i in range(8) for s in t]
    return spark.createDataFrame(rows, "dataset string, cluster_id bigint, series_id bigint, t bigint, value double")


@pytest.mark.parametrize("algo,bound", [("svdimp", 0.2), ("softimp", 0.8), ("cdrec_k2", 0.8), ("cdrec_k3", 0.5), ("svt", 2.0)])
def test_low_rank(factor_cluster, algo, bound):
    masked = I.mask_miss_perc(factor_cluster, 60, [20])
    out = I.impute_low_rank(masked, factor_cluster, algo, 200).collect()
    assert len(out) == 60
    assert all(r["imputed"] == r["value"] for r in out if not r["hidden"])
    err = np.sqrt(np.mean([(r["imputed"] - r["value"]) ** 2 for r in out if r["hidden"]]))
    assert err < bound


def test_als_keeps_known_cells(factor_cluster):
    masked = I.mask_miss_perc(factor_cluster, 60, [20, 40])
    out = I.impute_als(masked, factor_cluster).collect()
    assert len(out) == 120 and all(r["imputed"] == r["value"] for r in out if not r["hidden"])


def test_local_simple_of_short_and_constant_series(spark):
    """Only the series goes to Python and one number comes back; a constant series has no ratio."""
    rows = [("a", i, t, v) for i, x in enumerate([[1.0], [3.0, 3.0, 3.0], [1.0, 2.0, 1.0, 2.0], [0.0, 0.0, 1.0, 5.0, 2.0]]) for t, v in enumerate(x)]
    got = values(catch22.local_simple(spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double")))
    ratio = {k[1]: v for k, v in got.items() if k[2] == "FC_LocalSimple_mean1_tauresrat"}
    assert ratio == {1: None, 2: 1.0, 3: 0.5}


def test_mapped_arrays_leave_in_small_batches(series, monkeypatch):
    from gapmend.operators.features import common
    monkeypatch.setattr(common, "BATCH_VALUES", 180)  # two series of 90 steps
    df, data = series
    sizes = []
    arr = common.arrays(df).coalesce(1)
    monkeypatch.setattr(type(arr), "mapInPandas", lambda self, fn, schema: sizes.extend(len(p) for p in fn([self.toPandas()])) or self)
    common.map_arrays(arr, "y", lambda x: x[:1])
    assert sum(sizes) == len(data) and max(sizes) == 2

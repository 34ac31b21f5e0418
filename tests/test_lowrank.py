"""Imputers that see a cluster or a data set: dense solves, bounds, leaks, selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.operators import impute as I, lowrank as R

SHARES = (20, 60)


def dense(name, x, rounds, tol):
    """The completion on the whole (series x step) matrix."""
    gap = np.isnan(x)
    known = np.where(gap, 0.0, x)
    size = np.linalg.norm
    if name == "svt":
        tau, y = 0.5 * np.linalg.norm(known, 2), known.copy()
        for _ in range(rounds):
            u, s, v = np.linalg.svd(y, full_matrices=False)
            low = (u * np.maximum(s - tau, 0)) @ v
            miss = np.where(gap, 0.0, known - low)
            if size(miss) <= tol * size(known):
                break
            y = y + 1.2 * miss
        return np.where(gap, low, x)
    mean = known.sum(axis=1) / np.maximum((~gap).sum(axis=1), 1)
    full = np.where(gap, mean[:, None], x)
    for _ in range(rounds):
        if name.startswith("cdrec"):
            rest, low = full.copy(), np.zeros_like(full)
            for _ in range(int(name[-1])):
                z = R._sign_vector(rest @ rest.T)
                c = rest.T @ z
                c = c / size(c)
                part = np.outer(rest @ c, c)
                low, rest = low + part, rest - part
        else:
            u, s, v = np.linalg.svd(full, full_matrices=False)
            s = np.where(np.arange(len(s)) < R.RANK, s, 0.0) if name == "svdimp" else np.maximum(s - 0.05 * s.max(), 0.0)
            low = (u * s) @ v
        new = np.where(gap, low, x)
        done = size((new - full)[gap]) <= tol * size(new[gap])
        full = new
        if done:
            break
    return full


@pytest.fixture(scope="module")
def clusters(spark):
    """Two clusters of unequal size and unit with scattered nulls; a column nobody asked for."""
    rng = np.random.default_rng(8)
    data, rows = {}, []
    for c, (n, unit) in enumerate(((6, 1.0), (4, 1e-6))):
        x = unit * (rng.normal(size=(n, 2)) @ rng.normal(size=(2, 60)) + 0.1 * rng.normal(size=(n, 60)) + 2)
        x[rng.random((n, 60)) < 0.08] = np.nan
        x[:, 50] = np.nan
        data[c] = x
        rows += [("d", c, 10 * c + s, t, None if np.isnan(x[s, t]) else float(x[s, t]), "note") for s in range(n) for t in range(60)]
    return spark.createDataFrame(rows, "dataset string, cluster_id bigint, series_id bigint, t bigint, value double, bits string").repartition(7), data


def test_equals_a_dense_solve(clusters):
    df, data = clusters
    masked = I.mask_miss_perc(df.drop("bits"), shares=list(SHARES))
    out = R.impute_low_rank_all(masked, df).collect()
    assert len(out) == 5 * 2 * len(SHARES) * 60
    for name in R.ALGORITHMS:
        for c, x in data.items():
            for share in SHARES:
                m = x.copy()
                m[0, 4:4 + 60 * share // 100] = np.nan
                want = dense(name, m, R.ROUNDS, R.TOLERANCE)[0]
                got = {r["t"]: r["imputed"] for r in out if (r["algorithm"], r["cluster_id"], r["miss_perc"]) == (name, c, share)}
                # one round more or less at the tolerance is allowed
                assert np.array([got[t] for t in range(60)]) == pytest.approx(want, rel=1e-3, abs=1e-3 * np.nanmax(np.abs(x))), (name, c, share)


def test_rounds_end(clusters):
    df, _ = clusters
    masked = I.mask_miss_perc(df.drop("bits"), shares=list(SHARES))
    fit = R.low_rank_fit(masked, df).groupBy("algorithm").agg(F.min("converged").alias("ok"), F.max("rounds").alias("n")).collect()
    assert len(fit) == 5 and all(r["ok"] and r["n"] < R.ROUNDS for r in fit), fit
    short = R.low_rank_fit(masked, df, ["svdimp"], rounds=2).agg(F.max("rounds"), F.max("converged")).first()
    assert tuple(short) == (2, False)


def test_unbounded_cluster_is_an_error(spark):
    rows = [("d", 0, s, t, float(s + t)) for s in range(R.MAX_MEMBERS + 1) for t in range(12)]
    df = spark.createDataFrame(rows, "dataset string, cluster_id bigint, series_id bigint, t bigint, value double")
    with pytest.raises(Exception, match="explode_large_clusters"):
        I.impute_low_rank(I.mask_miss_perc(df), df, "svdimp").collect()


def test_empty_table_and_unknown_series(spark):
    schema = "dataset string, cluster_id bigint, series_id bigint, t bigint, value double"
    none = spark.createDataFrame([], schema)
    assert R.impute_low_rank_all(I.mask_miss_perc(none), none).count() == 0
    rows = [("d", 0, s, t, None if s == 0 else float(s + t)) for s in range(3) for t in range(8)]
    df = spark.createDataFrame(rows, schema)
    out = R.impute_low_rank_all(I.mask_miss_perc(df, shares=[50]), df).collect()
    assert len(out) == 5 * 8 and all(r["imputed"] == 0 for r in out)


def test_als_sees_nothing_hidden(clusters):
    """Other values in the hidden cells of a share, or another data set, change no imputed cell."""
    df, _ = clusters
    df = df.drop("bits")
    masked = I.mask_miss_perc(df, shares=list(SHARES))

    def guesses(m, cells):
        out = I.impute_als(m, cells).where("hidden AND dataset = 'd'").collect()
        return {(r["cluster_id"], r["miss_perc"], r["t"]): r["imputed"] for r in out}

    before = guesses(masked, df)
    other = masked.withColumn("value", F.when(F.col("hidden"), F.col("value") * 50 + 7).otherwise(F.col("value")))
    first = F.col("series_id").isin(0, 10) & (F.col("t") >= 4) & (F.col("t") < 4 + 36)
    changed = df.withColumn("value", F.when(first, F.col("value") * 50 + 7).otherwise(F.col("value")))
    after = guesses(other, changed)
    assert set(before) == set(after) and len(before) > 80
    assert all(after[k] == pytest.approx(v, rel=1e-4, abs=1e-12) for k, v in before.items())


def direct_selection(groups, n):
    """{cluster: random picks} by walking the scatter order."""
    order = sorted((s, c) for c, m in groups.items() for s in m)
    order.sort(key=lambda e: (((e[0] % 10007) * 7919 + 104729) % 10007, e[0]))
    return {c: {s for s, h in [e for e in order if e[1] != c][:n]} for c in groups}


def test_selection_beside_a_hot_cluster(spark):
    groups = {0: range(1, 2001), 1: range(3001, 3004), 2: [4001], 3: range(5001, 5008)}
    rows = [("d", c, s) for c, m in groups.items() for s in m]
    df = spark.createDataFrame(rows, "dataset string, cluster_id bigint, series_id bigint")
    picks = I.select_bench_series(df)
    assert not [f for f in picks.schema if "array" in f.dataType.simpleString()]
    got = {}
    for r in picks.where("role = 'random'").collect():
        got.setdefault(r["cluster_id"], set()).add(r["series_id"])
    assert got == direct_selection(groups, 10)


def by_hand(name, sums, known, rounds):
    """The coefficients after that many rounds of one table, round by round."""
    p, m = known.shape
    full = np.zeros((p, m + 1, m))
    full[:, np.arange(m), np.arange(m)] = known
    full[:, m, :] = np.where(known, 0.0, sums[:, :m, m].sum(axis=0) / np.maximum(np.einsum("pm,p->m", known, sums[:, m, m]), 1))
    for _ in range(rounds):
        gram = (full.transpose(0, 2, 1) @ sums @ full).sum(axis=0)
        full = np.where(known[:, None, :], full, full @ R._round_map(name, gram[None])[0].T)
    return full


def test_stacks_and_circles(monkeypatch):
    """Tables of a stack end as each alone; rounds that run in a circle are not all computed, and end in the same state."""
    rng = np.random.default_rng(1)
    tables = []
    for _ in range(40):
        x = rng.poisson(7, (12, 60)) * rng.uniform(15, 35, (12, 60))
        x[rng.random((12, 60)) < 0.01] = np.nan
        x[0, 4:40] = np.nan
        sets, at = np.unique(~np.isnan(x), axis=1, return_inverse=True)
        x = np.vstack([np.nan_to_num(x), np.ones(60)])
        tables.append((np.stack([x[:, at == i] @ x[:, at == i].T for i in range(sets.shape[1])]), sets.T))
    p = max(len(k) for _, k in tables)
    sums, known = np.zeros((40, p, 13, 13)), np.ones((40, p, 12), bool)
    for i, (s, k) in enumerate(tables):
        sums[i, :len(s)], known[i, :len(k)] = s, k
    calls, plain = [], R._round_map
    monkeypatch.setattr(R, "_round_map", lambda name, gram: calls.append(name) or plain(name, gram))
    circles = 0
    for name in ("cdrec_k3", "softimp"):
        coef, n, rest = R.complete(name, sums, known, R.ROUNDS, R.TOLERANCE)
        assert (n[~rest] == R.ROUNDS).all() and (n >= 1).all()
        done = len(calls)
        circles += (~rest).sum()
        for i, (s, k) in enumerate(tables):
            assert coef[i, :len(k)] == pytest.approx(by_hand(name, s, k, int(n[i])), rel=1e-8, abs=1e-8), (name, i)
        if name == "cdrec_k3":
            assert circles and done < R.ROUNDS / 2
        calls.clear()

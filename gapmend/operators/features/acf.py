"""Autocorrelation features and regressions on lagged values."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gapmend.operators.blocks import neighbours, with_halo
from gapmend.operators.features.common import K, centred, map_arrays, to_long

AGG_LAGS = 40
AR_ORDER = 10


def autocovariance(df: DataFrame, max_lag: int) -> DataFrame:
    """Per series: n, sd and ``rho``, an array of autocorrelations of lag 0..max_lag,

    sum (x_t - mu)(x_t+k - mu) / ((n - k) var); NULL where undefined. All lags come
    from one window pass with a halo of ``max_lag`` rows.
    """
    c = centred(df)
    lead = {f"l{k}": (lambda w, k=k: F.lead("xc", k).over(w)) for k in range(1, max_lag + 1)}
    d = neighbours(c, lead, 0, max_lag)
    w = d.groupBy(*K).agg(F.max("n").alias("n"), F.max("sd").alias("sd"), *[
        F.sum(F.col("xc") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    var = F.nullif(F.col("sd") * F.col("sd"), F.lit(0.0))
    one = F.when(var.isNotNull(), 1.0)
    rho = F.array(one, *[F.when(F.col("n") > k, F.col(f"s{k}") / ((F.col("n") - k) * var)) for k in range(1, max_lag + 1)])
    return w.select(*K, "n", "sd", rho.alias("rho"))


def autocorr(df: DataFrame) -> DataFrame:
    """Autocorrelation of lag 0-9 and mean, median and variance over lags 1-40."""
    a = autocovariance(df, AGG_LAGS)
    tail = a.select(*K, "rho", F.expr(f"filter(slice(rho, 2, {AGG_LAGS}), x -> x IS NOT NULL)").alias("r"))
    m = F.size("r")
    mean = F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / F.nullif(m, F.lit(0))
    tail = tail.withColumn("mean", mean).withColumn("sorted", F.array_sort("r"))
    med = (F.try_element_at("sorted", F.floor((m + 1) / 2).cast("int")) + F.try_element_at("sorted", F.floor((m + 2) / 2).cast("int"))) / 2
    var = F.aggregate("r", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(m, F.lit(0))
    out = {f"autocorrelation__lag_{k}": F.col("rho")[k] for k in range(10)}
    for name, c in (("mean", F.col("mean")), ("median", med), ("var", var)):
        out[f'agg_autocorrelation__f_agg_"{name}"__maxlag_{AGG_LAGS}'] = c
    return to_long(tail, out)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def durbin_levinson(df: DataFrame, rho: Column, order: int) -> DataFrame:
    """Add columns ``pacf1`` .. ``pacf<order>`` from an autocorrelation array.

    One fold over the orders carries the current coefficients and the result.
    """
    first = F.array(rho[1])

    def step(s, k):
        past = F.slice(rho, 2, k - 1)
        top = rho[k] - _dot(s["phi"], F.reverse(past))
        low = F.nullif(1.0 - _dot(s["phi"], past), F.lit(0.0))
        # a one-element transform binds the new coefficient once
        return F.transform(F.array(top / low), lambda p: F.struct(
            F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - p * b), F.array(p)).alias("phi"),
            F.concat(s["pacf"], F.array(p)).alias("pacf")))[0]

    fold = F.aggregate(F.sequence(F.lit(2), F.lit(order)), F.struct(first.alias("phi"), first.alias("pacf")), step, lambda s: s["pacf"])
    out = df.withColumn("pacf", fold)
    return out.withColumns({f"pacf{k}": F.col("pacf")[k - 1] for k in range(1, order + 1)}).drop("pacf")


def partial_autocorr(df: DataFrame, order: int = 6) -> DataFrame:
    a = durbin_levinson(autocovariance(df, order), F.col("rho"), order)
    return to_long(a, {"partial_autocorrelation__lag_0": F.col("rho")[0],
                       **{f"partial_autocorrelation__lag_{k}": F.col(f"pacf{k}") for k in range(1, order + 1)}})


# --- normal equations of lag regressions -------------------------------------------

def lag_gram(df: DataFrame, lags: int, width: int, design, head: int = 0) -> DataFrame:
    """Sum of outer products of the rows that ``design(values)`` builds, per series.

    A series is cut into blocks (with ``lags`` rows of history), each block gives one
    partial Gram matrix and the partials are added by key, so neither a long series
    nor many series meet in one task. ``head`` first values are kept alongside.
    """
    b = with_halo(df.select(*K, "t", "value"), before=lags)
    packed = b.groupBy(*K, "blk").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("r"))
    packed = packed.select(*K, "blk", F.col("r")[0]["t"].alias("t0"), F.transform("r", lambda v: v["value"]).alias("x"))

    def run(batches):
        for pdf in batches:
            gram = []
            for t0, blk, x in zip(pdf["t0"], pdf["blk"], pdf["x"]):
                m = design(np.asarray(x, dtype=float))
                gram.append((m.T @ m).ravel() if len(m) else np.zeros(width * width))
            yield pd.DataFrame({"dataset": pdf["dataset"], "series_id": pdf["series_id"], "blk": pdf["blk"], "gram": gram})

    part = packed.mapInPandas(run, "dataset string, series_id bigint, blk bigint, gram array<double>")
    flat = part.select(*K, F.posexplode("gram").alias("p", "g")).groupBy(*K, "p").agg(F.sum("g").alias("g"))
    gram = flat.groupBy(*K).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "g"))), lambda v: v["g"]).alias("gram"))
    if head:
        first = df.where(F.col("t") < head).groupBy(*K).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("t", "value"))), lambda v: v["value"]).alias("first"))
        gram = gram.join(first, K)
    return gram


def ar(df: DataFrame, order: int = AR_ORDER) -> DataFrame:
    """Last coefficient of an autoregression with constant, by least squares."""
    c = centred(df).select(*K, "t", F.col("xc").alias("value"))
    width = order + 2

    def design(x):
        n = len(x) - order
        if n <= 0:
            return np.zeros((0, width))
        cols = [np.ones(n)] + [x[order - k: order - k + n] for k in range(1, order + 1)] + [x[order:]]
        return np.stack(cols, axis=1)

    def last(g):
        g = g.reshape(width, width)
        if g[0, 0] < width or np.linalg.cond(g[:-1, :-1]) > 1e14:
            return np.array([np.nan])
        return np.linalg.solve(g[:-1, :-1], g[:-1, -1])[-1:]

    out = map_arrays(lag_gram(c, order, width, design), "phi", last, "gram")
    return to_long(out, {f"ar_coefficient__coeff_{order}__k_{order}": F.nanvl(F.col("phi")[0], F.lit(None))})


def adf_max_lag(n: int) -> int:
    return max(0, min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2))


def _max_lag(n: Column) -> Column:
    """``adf_max_lag`` of a column."""
    return F.greatest(F.lit(0), F.least(F.ceil(F.round(12 * F.pow(n / 100, F.lit(0.25)), 9)), F.floor(n / 2) - 2)).cast("int")


def adf(df: DataFrame, steps: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistic and lag with the lowest AIC (constant term).

    All candidate lags are nested in one Gram matrix over the common sample; the
    final fit adds the few rows that a shorter lag makes available. Without ``steps`` the
    lag bound follows the length of each data set.
    """
    if steps is not None:
        return _adf(df, adf_max_lag(steps))
    sets = df.groupBy("dataset").agg((F.max("t") - F.min("t") + 1).alias("n")).withColumn("top", _max_lag(F.col("n")))
    # the bound grows with the fourth root of the length: few values, however many data sets there are
    tops = {r["top"]: r["n"] for r in sets.groupBy("top").agg(F.max("n").alias("n")).collect()} or {0: 0}
    tagged = df.join(sets.select("dataset", "top"), "dataset")
    return reduce(DataFrame.unionByName, [adf(tagged.where(F.col("top") == top).drop("top"), n) for top, n in sorted(tops.items())])


def _adf(df: DataFrame, top: int) -> DataFrame:
    """``adf`` with one lag bound for all series."""
    c = centred(df).select(*K, "t", F.col("xc").alias("value"))
    width = top + 3

    def rows(x, p, start, stop):
        # columns: constant, level, differences of lag 1..p, target
        d = np.diff(x)
        t = np.arange(start, stop)
        cols = [np.ones(len(t)), x[t]] + [d[t - k] for k in range(1, p + 1)] + [d[t]]
        return np.stack(cols, axis=1)

    def design(x):
        return rows(x, top, top, len(x) - 1) if len(x) - 1 > top else np.zeros((0, width))

    def fit(g, p):
        use = list(range(p + 2))
        a, b, yy, n = g[np.ix_(use, use)], g[use, -1], g[-1, -1], g[0, 0]
        if n <= p + 2 or np.linalg.cond(a) > 1e14:
            return None
        beta = np.linalg.solve(a, b)
        rss = max(float(yy - b @ beta), 1e-300)
        return beta, rss, np.linalg.inv(a), n

    def stat(v):
        g, x = v[:width * width].reshape(width, width), v[width * width:]
        best = None
        for p in range(top + 1):
            f = fit(g, p)
            if f is None:
                continue
            aic = f[3] * np.log(f[1] / f[3]) + 2 * (p + 2)
            if best is None or aic < best[0] - 1e-9:
                best = (aic, p)
        if best is None:
            return np.array([np.nan, np.nan])
        p = best[1]
        keep = list(range(p + 2)) + [width - 1]
        g2 = g[np.ix_(keep, keep)]
        if p < top:
            extra = rows(x, p, p, top)
            g2 = g2 + extra.T @ extra
        f = fit(g2, p)
        if f is None:
            return np.array([np.nan, np.nan])
        beta, rss, inv, n = f
        return np.array([beta[1] / np.sqrt(rss / (n - p - 2) * inv[1, 1]), p])

    gram = lag_gram(c, top + 1, width, design, head=top + 2)
    gram = gram.withColumn("v", F.concat("gram", "first"))
    out = map_arrays(gram, "res", stat, "v")
    name = 'augmented_dickey_fuller__attr_"%s"__autolag_"AIC"'
    return to_long(out, {name % "teststat": F.nanvl(F.col("res")[0], F.lit(None)), name % "usedlag": F.nanvl(F.col("res")[1], F.lit(None))})


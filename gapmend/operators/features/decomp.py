"""Stability, level-shift, decomposition, unit-root and scaling features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gapmend.functions.columns import div
from gapmend.operators.blocks import neighbours, prefix_sums, runs
from gapmend.operators.features.acf import autocovariance, durbin_levinson, lag_gram
from gapmend.operators.features.catch22 import acf_arrays, first_zero, _first, _range
from gapmend.operators.features.common import K, centred, map_arrays, arrays, to_long, with_stats
from gapmend.operators.features.entropy import bin_of

WINDOW = 20
SEASON = 7


def chunk_stats(df: DataFrame) -> DataFrame:
    """Variance of chunk variances (lumpiness) and of chunk means (stability)."""
    c = with_stats(df, n=F.count("value"))
    size = F.when(F.col("n") >= 2 * WINDOW, WINDOW).otherwise(F.greatest(F.floor(F.col("n") / 2), F.lit(1)))
    g = c.groupBy(*K, F.floor(F.col("t") / size).alias("c")).agg(F.var_pop("value").alias("v"), F.avg("value").alias("m"))
    w = g.groupBy(*K).agg(F.var_pop("v").alias("lump"), F.var_pop("m").alias("stab"))
    return to_long(w, {"lumpiness": F.col("lump"), "stability": F.col("stab")})


def simple(df: DataFrame) -> DataFrame:
    c = with_stats(df, mu=F.avg("value"), med=F.percentile("value", F.lit(0.5)), lo=F.min("value"), hi=F.max("value"))
    c = neighbours(c, {"nx": lambda w: F.lead("value").over(w)}, 0, 1)
    v = F.col("value")
    w = c.groupBy(*K).agg(
        F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.count(v).alias("length"), F.stddev_pop(F.col("nx") - v).alias("std1st_der"),
        F.count_if((v > F.col("med")) != (F.col("nx") > F.col("med"))).alias("crossing_points"),
        F.avg((v > F.col("mu")).cast("double")).alias("binarize_mean"))
    decile = bin_of(v, F.col("lo"), F.col("hi"), 10)
    flat = runs(c.select(*K, "t", decile.alias("dec")), F.col("dec")).groupBy(*K).agg(F.max("length").alias("flat_spots"))
    h = c.groupBy(*K, "lo", "hi", decile.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    mode = h.groupBy(*K).agg(F.min_by(F.col("lo") + (F.col("hi") - F.col("lo")) / 10 * F.col("b"), F.struct(-F.col("c"), "b")).alias("histogram_mode"))
    w = w.join(flat, K).join(mode, K)
    return to_long(w, {c: F.col(c) for c in w.columns if c not in K})


def _biased_rho(df: DataFrame, top: int) -> DataFrame:
    """Autocorrelations with the full-sample divisor, lag 0..top (0 for constant series)."""
    a = autocovariance(df, top)
    return a.select(*K, F.transform("rho", lambda r, i: F.coalesce(r * (F.col("n") - i) / F.col("n"), F.lit(0.0))).alias("rho"))


def acf_profile(df: DataFrame, season: int = SEASON) -> DataFrame:
    """Autocorrelation and partial autocorrelation summaries of the series and its
    first and second differences, and at the season."""
    top = max(season, 10)
    d = neighbours(df, {"d1": lambda w: F.col("value") - F.lag("value").over(w),
                        "d2": lambda w: F.col("value") - 2 * F.lag("value").over(w) + F.lag("value", 2).over(w)}, 2, 0)
    parts = []
    for name, col, shift in (("y", "value", 0), ("diff1y", "d1", 1), ("diff2y", "d2", 2)):
        s = d.where(F.col(col).isNotNull()).select(*K, (F.col("t") - shift).alias("t"), F.col(col).alias("value"))
        r = durbin_levinson(_biased_rho(s, top), F.col("rho"), 7 if name == "y" else 5)
        sq = lambda k: F.col(k) * F.col(k)
        out = {f"{name}_acf1": F.col("rho")[1],
               f"{name}_acf5": sum((F.col("rho")[k] * F.col("rho")[k] for k in range(1, 6)), F.lit(0.0)),
               f"{name}_pacf5": sum((F.coalesce(sq(f"pacf{k}"), F.lit(0.0)) for k in range(1, 6)), F.lit(0.0))}
        if name == "y":
            out |= {"seas_acf1": F.col("rho")[season], "seas_pacf1": F.coalesce(F.col("pacf7"), F.lit(0.0))}
        parts.append(to_long(r, out))
    a = acf_arrays(df)
    ac, n = F.col("ac"), F.col("n")
    parts.append(to_long(a, {"firstmin_ac": _first(_range(1, n - 2), lambda j: (ac[j] < ac[j - 1]) & (ac[j] < ac[j + 1]), n),
                             "firstzero_ac": first_zero(ac, n)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def level_shift(df: DataFrame, width: int = WINDOW) -> DataFrame:
    """Largest jump between the means of two adjacent windows, and where."""
    d = neighbours(df, {
        "a": lambda w: F.avg("value").over(w.rowsBetween(-width, -1)), "b": lambda w: F.avg("value").over(w.rowsBetween(0, width - 1)),
        "full": lambda w: F.lag("t", width).over(w).isNotNull() & F.lead("t", width - 1).over(w).isNotNull()}, width, width)
    jump = F.round(F.abs(F.col("b") - F.col("a")), 9)
    w = d.groupBy(*K).agg(F.max(F.when(F.col("full"), F.struct(jump.alias("size"), (-F.col("t")).alias("t")))).alias("m"))
    return to_long(w, {"level_shift_idx": F.coalesce(-F.col("m.t"), F.lit(0)), "level_shift_size": F.coalesce(F.col("m.size"), F.lit(0.0))})


def trend_season(df: DataFrame, period: int = SEASON) -> DataFrame:
    """Additive decomposition: centred moving-average trend, seasonal means, remainder.

    The moving average replaces a loess decomposition.
    """
    h = period // 2
    d = neighbours(df, {"trend": lambda w: F.avg("value").over(w.rowsBetween(-h, h))}, h, h)
    d = d.withColumn("detr", F.col("value") - F.col("trend")).withColumn("phase", F.pmod("t", F.lit(period)))
    season = d.groupBy(*K, "phase").agg(F.avg("detr").alias("season"))
    whole = d.groupBy(*K).agg(F.avg("detr").alias("level"))
    d = d.join(season, [*K, "phase"]).join(whole, K).withColumn("season", F.col("season") - F.col("level"))
    d = d.withColumn("rem", F.col("detr") - F.col("season"))
    s = d.groupBy(*K).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.var_pop("rem").alias("vr"), F.var_pop(F.col("trend") + F.col("rem")).alias("vtr"),
        F.var_pop(F.col("season") + F.col("rem")).alias("vsr"), F.sum("rem").alias("s1"), F.sum(F.col("rem") * F.col("rem")).alias("s2"),
        F.min(F.struct((-F.round("season", 9)).alias("o"), "phase")).alias("hi"), F.min(F.struct(F.round("season", 9).alias("o"), "phase")).alias("lo"))
    # spikiness: variance of the leave-one-out variances of the remainder
    x = F.col("rem")
    m = F.col("n") - 1
    loo = (F.col("s2") - x * x) / m - ((F.col("s1") - x) / m) * ((F.col("s1") - x) / m)
    spike = d.select(*K, "rem").join(s, K).groupBy(*K).agg(F.var_pop(loo).alias("spikiness"))
    lin = df.groupBy(*K).agg(div(F.covar_pop("t", "value"), F.var_pop("t") * F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias("linearity"))
    w = s.join(spike, K).join(lin, K)
    strength = lambda v: F.coalesce(F.greatest(F.lit(0.0), 1 - div("vr", v)), F.lit(0.0))
    return to_long(w, {"trend_strength": strength("vtr"), "seasonality_strength": strength("vsr"), "spikiness": F.col("spikiness"),
                       "peak": F.col("hi.phase"), "trough": F.col("lo.phase"), "linearity": F.col("linearity")})


def kpss(df: DataFrame, lag_n: int = 8) -> DataFrame:
    """KPSS statistic around a level, Bartlett weights over 4 (n / 100)^(1/4) lags."""
    c = centred(df)
    run = prefix_sums(c, {"cum": "xc"})
    lead = {f"l{k}": (lambda w, k=k: F.lead("xc", k).over(w)) for k in range(1, lag_n + 1)}
    lr = neighbours(c, lead, 0, lag_n).groupBy(*K).agg(
        F.max("n").cast("double").alias("n"), F.sum(F.col("xc") * F.col("xc")).alias("g0"),
        *[F.coalesce(F.sum(F.col("xc") * F.col(f"l{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lag_n + 1)])
    top = F.least(F.lit(lag_n), F.floor(4 * F.pow(F.col("n") / 100, F.lit(0.25))))
    s2 = (F.col("g0") + 2 * sum((F.when(F.lit(k) <= top, (1 - k / (top + 1)) * F.col(f"g{k}")).otherwise(0.0)
                                 for k in range(1, lag_n + 1)), F.lit(0.0))) / F.col("n")
    kp = run.groupBy(*K).agg(F.sum(F.col("cum") * F.col("cum")).alias("ss"))
    w = lr.withColumn("s2", s2).join(kp, K)
    return to_long(w, {"unitroot_kpss": div("ss", F.col("n") * F.col("n") * F.col("s2"))})


def heterogeneity(df: DataFrame, lags: int = 4) -> DataFrame:
    """R^2 of the squared values on their own lags (ARCH effect)."""
    c = centred(df)
    sq = c.select(*K, "t", F.coalesce(div(F.col("xc") * F.col("xc"), F.col("sd") * F.col("sd")), F.lit(0.0)).alias("value"))
    width = lags + 2

    def design(x):
        m = len(x) - lags
        if m <= 0:
            return np.zeros((0, width))
        return np.stack([np.ones(m)] + [x[lags - k: lags - k + m] for k in range(1, lags + 1)] + [x[lags:]], axis=1)

    def r2(g):
        g = g.reshape(width, width)
        n = g[0, 0]
        if n <= width or np.linalg.cond(g[:-1, :-1]) > 1e14:
            return np.array([0.0])
        beta = np.linalg.solve(g[:-1, :-1], g[:-1, -1])
        tss = g[-1, -1] - g[0, -1] ** 2 / n
        return np.array([1 - (g[-1, -1] - g[:-1, -1] @ beta) / tss if tss > 1e-12 else 0.0])

    return to_long(map_arrays(lag_gram(sq, lags, width, design), "r2", r2, "gram"), {"heterogeneity": F.col("r2")[0]})


def entropy_hurst(df: DataFrame, max_lag: int = 20) -> DataFrame:
    """Normalised spectral entropy and the Hurst exponent (slope of ln sd of lagged
    differences on ln lag)."""
    def power(x):
        p = np.abs(np.fft.rfft(x - x.mean())) ** 2
        return p[1:]
    s = map_arrays(arrays(df), "p", power).select(*K, F.explode("p").alias("p"))
    tot = s.groupBy(*K).agg(F.sum("p").alias("tot"), F.count(F.lit(1)).alias("m"))
    q = div("p", "tot")
    ent = s.join(tot, K).groupBy(*K).agg(
        (F.sum(F.when(q > 1e-15, -q * F.log(q)).otherwise(0.0)) / F.log(F.max("m").cast("double"))).alias("entropy"))
    lead = {f"l{k}": (lambda w, k=k: F.lead("value", k).over(w) - F.col("value")) for k in range(2, max_lag)}
    g = neighbours(df, lead, 0, max_lag).groupBy(*K).agg(*[F.stddev_pop(f"l{k}").alias(f"s{k}") for k in range(2, max_lag)])
    pts = g.select(*K, F.explode(F.array(*[F.struct(F.log(F.lit(float(k))).alias("x"), F.log(F.nullif(F.col(f"s{k}"), F.lit(0.0))).alias("y"))
                                           for k in range(2, max_lag)])).alias("p")).select(*K, "p.x", "p.y").where("y IS NOT NULL")
    hurst = pts.groupBy(*K).agg(F.regr_slope("y", "x").alias("hurst"))
    return to_long(ent.join(hurst, K, "left"), {"entropy": F.col("entropy"), "hurst": F.col("hurst")})

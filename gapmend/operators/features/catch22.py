"""The 22 canonical time-series measures, on z-normalised series.

Measures that look at neighbouring values are sums over time blocks. Those that
need the whole autocorrelation or an order of all values take one array per series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gapmend.operators import blocks
from gapmend.operators.blocks import block_of, carry, neighbours, prefix_sums
from gapmend.operators.correlate import key_schema
from gapmend.operators.features.common import K, arrays, map_arrays, to_long, with_stats
from gapmend.operators.features.entropy import bin_of, entropy_of
from gapmend.session import cut_lineage

TAU_STEPS, MIN_POINTS = 50, 6
#: Every step, and every second step.
LAGS = (1, 2)


def _first(idx: Column, cond, default: Column) -> Column:
    """First element of the index array that satisfies ``cond``."""
    return F.coalesce(F.try_element_at(F.filter(idx, cond), F.lit(1)), default)


def _range(lo, hi: Column) -> Column:
    """Integers lo..hi, empty when hi < lo."""
    lo = F.lit(lo)
    return F.when(hi >= lo, F.sequence(lo, hi.cast("int"))).otherwise(F.array().cast("array<int>"))


def _acf(x: np.ndarray) -> np.ndarray:
    y = x - x.mean()
    size = 1 << (2 * len(y) - 1).bit_length()
    p = np.fft.rfft(y, size)
    c = np.fft.irfft(p * np.conj(p), size)[:len(y)]
    return c / c[0] if c[0] > 1e-12 else np.zeros(len(y))


def acf_arrays(df: DataFrame) -> DataFrame:
    """(dataset, series_id, x, n, ac): full biased autocorrelation."""
    return map_arrays(arrays(df), "ac", _acf)


def first_zero(ac: Column, n: Column) -> Column:
    """First lag whose autocorrelation is not positive; n if there is none."""
    return _first(_range(0, n - 1), lambda i: F.round(ac[i], 9) <= 0, n)


def histogram_mode(df: DataFrame) -> DataFrame:
    c = with_stats(df, lo=F.min("value"), hi=F.max("value"))
    rows = c.select(*K, "lo", "hi", F.explode(F.array(*[F.struct(
        F.lit(b).alias("bins"), bin_of(F.col("value"), F.col("lo"), F.col("hi"), b).alias("b")) for b in (5, 10)])).alias("h"))
    h = rows.groupBy(*K, "lo", "hi", F.col("h.bins").alias("bins"), F.col("h.b").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    g = h.groupBy(*K, "lo", "hi", "bins").agg(F.collect_list(F.struct("c", "b")).alias("h"))
    top = F.filter("h", lambda e: e["c"] == F.array_max(F.transform("h", lambda z: z["c"])))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    centre = F.aggregate(top, F.lit(0.0), lambda s, e: s + F.col("lo") + width * (e["b"] + 0.5)) / F.size(top)
    return g.select(*K, F.format_string("DN_HistogramMode_%d", "bins").alias("feature"), centre.alias("value"))


def acf_summaries(df: DataFrame) -> DataFrame:
    a = acf_arrays(df)
    ac, n = F.col("ac"), F.col("n")
    thr = math.exp(-1)
    i = _first(_range(0, n - 3), lambda j: ac[j + 1] < thr, F.lit(-1))
    cross = F.when(i >= 0, i + (F.lit(thr) - ac[i]) / (ac[i + 1] - ac[i])).otherwise(n)
    dip = _first(_range(1, n - 2), lambda j: (ac[j] < ac[j - 1]) & (ac[j] < ac[j + 1]), n)

    def gaussian_ami(x: np.ndarray) -> np.ndarray:
        top = min(40, int(math.ceil(len(x) / 2)))
        out = np.zeros(top)
        for lag in range(1, top + 1):
            u, v = x[:-lag], x[lag:]
            den = u.std() * v.std()
            r = ((u - u.mean()) * (v - v.mean())).mean() / den if den > 1e-12 else 0.0
            out[lag - 1] = -0.5 * np.log(max(1 - r * r, 1e-300))
        return out

    a = map_arrays(a, "ami", gaussian_ami)
    ami = F.col("ami")
    fm = _first(_range(1, F.size(ami) - 2), lambda j: (ami[j] < ami[j - 1]) & (ami[j] < ami[j + 1]), F.size(ami))
    return to_long(a, {"CO_f1ecac": cross, "CO_FirstMin_ac": dip, "IN_AutoMutualInfoStats_40_gaussian_fmmi": fm})


def histogram_ami(df: DataFrame, lag: int = 2, bins: int = 5) -> DataFrame:
    """Mutual information of x_t and x_t+lag on a bins x bins grid, as H1 + H2 - H12."""
    c = with_stats(df, lo=F.min("value"), hi=F.max("value"))
    d = neighbours(c, {"nx": lambda w: F.lead("value", lag).over(w)}, 0, lag).where("nx IS NOT NULL")
    lo, hi = F.col("lo") - 0.1, F.col("hi") + 0.1
    joint = d.groupBy(*K, bin_of(F.col("value"), lo, hi, bins).alias("p"), bin_of(F.col("nx"), lo, hi, bins).alias("q")).agg(
        F.count(F.lit(1)).alias("c"))
    side = lambda s: entropy_of(joint.groupBy(*K, s).agg(F.sum("c").alias("c")), K, "h" + s)
    w = entropy_of(joint, K, "hj").join(side("p"), K).join(side("q"), K)
    return to_long(w, {"CO_HistogramAMI_even_2_5": F.col("hp") + F.col("hq") - F.col("hj")})


def differences(df: DataFrame) -> DataFrame:
    d = neighbours(df, {"nx": lambda w: F.lead("value").over(w)}, 0, 1)
    s = F.col("nx") - F.col("value")
    w = d.groupBy(*K).agg(F.avg(s * s * s).alias("trev"), F.avg((F.abs(s) * 1000 > 40).cast("double")).alias("pnn"))
    return to_long(w, {"CO_trev_1_num": F.col("trev"), "MD_hrv_classic_pnn40": F.col("pnn")})


def _longest_gap(df: DataFrame, name: str) -> DataFrame:
    """Largest distance from a break to the previous one (the first counts from 0)."""
    after = neighbours(df, {"pb": lambda w: F.when(F.lag("brk").over(w), F.col("t") - 1)}, 1, 0)
    last = carry(after.withColumn("pb", F.col("pb").cast("double")), "pb")
    return last.where("brk").groupBy(*K).agg(F.max(F.col("t") - F.coalesce(F.col("prev.v"), F.lit(0.0))).alias(name))


def stretches(df: DataFrame) -> DataFrame:
    c = with_stats(df, mu=F.avg("value"), n=F.count("value"))
    c = neighbours(c, {"nx": lambda w: F.lead("value").over(w)}, 0, 1).where("nx IS NOT NULL")
    end = F.col("t") == F.col("n") - 2
    up = _longest_gap(c.withColumn("brk", end | (F.col("value") <= F.col("mu"))), "up")
    down = _longest_gap(c.withColumn("brk", end | (F.col("nx") >= F.col("value"))), "down")
    return to_long(up.join(down, K), {"SB_BinaryStats_mean_longstretch1": F.col("up"), "SB_BinaryStats_diff_longstretch0": F.col("down")})


def _words(x: np.ndarray) -> np.ndarray:
    """Counts of the nine pairs of consecutive tercile letters (midpoint quantiles)."""
    if len(x) < 2:
        return np.zeros((3, 3))
    cuts = np.interp(len(x) * np.array([1 / 3, 2 / 3]) - 0.5, np.arange(len(x)), np.sort(x))
    letter = (x[:, None] > cuts).sum(axis=1)
    return np.bincount(letter[:-1] * 3 + letter[1:], minlength=9).reshape(3, 3).astype(float)


def _motif(v: np.ndarray) -> np.ndarray:
    """Entropy of letter pairs, and the trace of the covariance of the transition
    matrix of the series sampled at its first zero autocorrelation (given first)."""
    tau, x = int(v[0]), v[1:]
    p = _words(x).ravel() / max(len(x) - 1, 1)
    p = p[p > 0]
    move = _words(x[::tau])
    trace = (move / move.sum()).var(axis=0, ddof=1).sum() if move.sum() > 0 else np.nan
    return np.array([-(p * np.log(p)).sum(), trace])


def motifs(df: DataFrame) -> DataFrame:
    a = acf_arrays(df)
    a = map_arrays(a.select(*K, F.concat(F.array(first_zero(F.col("ac"), F.col("n")).cast("double")), "x").alias("v")), "m", _motif, "v")
    return to_long(a, {"SB_MotifThree_quantile_hh": F.col("m")[0], "SB_TransitionMatrix_3ac_sumdiagcov": F.nanvl(F.col("m")[1], F.lit(None))})


def _first_zero(ac: np.ndarray) -> float:
    """As ``first_zero``, inside a task."""
    at = np.flatnonzero(ac.round(9) <= 0)
    return float(at[0]) if len(at) else float(len(ac))


def _zero_ratio(x: np.ndarray) -> np.ndarray:
    """First zero of the differences' autocorrelation over that of the series, NaN for a constant one; nothing without differences."""
    d, first = np.diff(x), _first_zero(_acf(x))
    return np.array([_first_zero(_acf(d)) / first if first else np.nan] if len(d) else [])


def local_simple(df: DataFrame) -> DataFrame:
    a = map_arrays(arrays(df).select(*K, "x"), "ratio", _zero_ratio, keep=False).where(F.size("ratio") > 0)
    d = neighbours(df, {f"l{k}": (lambda w, k=k: F.lag("value", k).over(w)) for k in (1, 2, 3)}, 3, 0)
    r = F.col("value") - (F.col("l1") + F.col("l2") + F.col("l3")) / 3
    w = a.select(*K, F.nanvl(F.col("ratio")[0], F.lit(None)).alias("ratio")).join(d.groupBy(*K).agg(F.stddev_samp(r).alias("sd")), K)
    return to_long(w, {"FC_LocalSimple_mean1_tauresrat": F.col("ratio"), "FC_LocalSimple_mean3_stderr": F.col("sd")})


def _outlier(y: np.ndarray) -> float:
    """Median over rising thresholds of the median position of the exceeding values."""
    top, total = y.max(), int((y >= 0).sum())
    if top < 0.01 or np.ptp(y) == 0:
        return 0.0
    n_thr = int(top / 0.01) + 1
    mid, lim_share, lim_nan = np.zeros(n_thr), 0, n_thr - 1
    for j in range(n_thr - 1, -1, -1):
        idx = np.flatnonzero(y >= j * 0.01)
        mid[j] = np.median(idx + 1) / (len(y) / 2.0) - 1.0
        if lim_share == 0 and (len(idx) - 1) * 100.0 / total > 2:
            lim_share = j
        if len(idx) <= 1:
            lim_nan = j
    return float(np.median(mid[:min(lim_share, lim_nan) + 1]))


def outliers(df: DataFrame) -> DataFrame:
    a = map_arrays(arrays(df), "o", lambda x: np.array([_outlier(x), _outlier(-x)]))
    return to_long(a, {"DN_OutlierInclude_p_001_mdrmd": F.col("o")[0], "DN_OutlierInclude_n_001_mdrmd": F.col("o")[1]})


def _embed_fit(v: np.ndarray) -> np.ndarray:
    """Mean deviation of the distance histogram in the lagged plane from an exponential."""
    tau, x = int(v[0]), v[1:]
    d = np.hypot(np.diff(x)[:-tau], np.diff(x)[tau:])
    if len(d) < 2 or d.std(ddof=1) < 1e-3:
        return np.array([0.0])
    scale = d.mean()
    bins = int(np.ceil(np.ptp(d) / (3.5 * d.std(ddof=1) / len(d) ** (1 / 3))))
    if bins < 1:
        return np.array([0.0])
    count, edges = np.histogram(d, bins=bins)
    fit = np.exp(-(edges[:-1] + edges[1:]) * 0.5 / scale) / scale
    return np.array([np.abs(count / len(d) - np.maximum(fit, 0)).mean()])


def embedding_fit(df: DataFrame) -> DataFrame:
    a = acf_arrays(df)
    tau = F.greatest(F.lit(1), F.least(first_zero(F.col("ac"), F.col("n")), F.floor(F.col("n") / 10).cast("int")))
    a = map_arrays(a.withColumn("v", F.concat(F.array(tau.cast("double")), "x")), "e", _embed_fit, "v")
    return to_long(a, {"CO_Embed2_Dist_tau_d_expfit_meandiff": F.col("e")[0]})


def spectrum_summaries(df: DataFrame) -> DataFrame:
    """Power in the lowest fifth of the spectrum and the frequency that halves it."""
    def power(x):
        size = 1 << max(1, (len(x) - 1).bit_length())
        p = np.abs(np.fft.rfft(x - x.mean(), size)) ** 2 / len(x)
        p[1:-1] *= 2
        return p / (2 * math.pi)
    a = map_arrays(arrays(df), "p", power)
    s = a.select(*K, F.size("p").alias("m"), F.posexplode("p").alias("k", "s"))
    tot = s.groupBy(*K).agg(F.sum("s").alias("total"), F.max("m").alias("m"), F.sum(
        F.when(F.col("k") < F.floor(F.col("m") / 5), F.col("s"))).alias("low"))
    dw = 2 * math.pi / (2 * (F.col("m") - 1))
    cum = a.select(*K, "p", F.aggregate(
        "p", F.struct(F.lit(0.0).alias("acc"), F.array().cast("array<double>").alias("run")),
        lambda st, v: F.struct((st["acc"] + v).alias("acc"), F.concat(st["run"], F.array(st["acc"] + v)).alias("run")),
        lambda st: st["run"]).alias("run"))
    at = _first(_range(0, F.size("run") - 1), lambda i: F.round(F.col("run")[i], 9) > F.round(F.col("total") / 2, 9), F.lit(0))
    w = cum.join(tot, K)
    return to_long(w, {"SP_Summaries_welch_rect_area_5_1": F.col("low") * dw, "SP_Summaries_welch_rect_centroid": at * dw})


def fluctuation_scales(n: int) -> list[int]:
    """Distinct rounded window lengths, evenly spaced in log between 5 and n/2."""
    lo, hi = math.log(5), math.log(max(n // 2, 1))
    return sorted({int(math.floor(math.exp(lo + i * (hi - lo) / (TAU_STEPS - 1)) + 0.5)) for i in range(TAU_STEPS)})


def _line_residuals(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    xc = x - x.mean()
    return y - y.mean(axis=-1, keepdims=True) - ((y * xc).sum(axis=-1, keepdims=True) / (xc * xc).sum()) * xc


def _best_split(v: np.ndarray) -> np.ndarray:
    """Share of the scales left of where the log-log curve is best split in two lines (scales, then fluctuations)."""
    m = len(v) // 2
    lt, lf = np.log(v[:m]), np.log(np.maximum(v[m:], 1e-300))
    cut = np.arange(MIN_POINTS, m - MIN_POINTS + 1)[:, None]
    err = 0
    for w in (np.arange(m) < cut, np.arange(m) >= cut - 1):  # one row per split
        n = w.sum(axis=1, keepdims=True)
        xc = (lt - (w * lt).sum(axis=1, keepdims=True) / n) * w
        yc = (lf - (w * lf).sum(axis=1, keepdims=True) / n) * w
        slope = (xc * yc).sum(axis=1, keepdims=True) / (xc * xc).sum(axis=1, keepdims=True)
        err = err + np.sqrt(((yc - slope * xc) ** 2).sum(axis=1))
    return np.array([(int(np.argmin(np.round(err, 9))) + MIN_POINTS) / m])


def _places(seg: int, tau: int, first: int, size: int) -> np.ndarray:
    """Places in window ``seg`` of ``size`` steps from step ``first`` on, as distances from its middle."""
    return np.arange(first, first + size) - seg * tau - (tau - 1) / 2


def _windows(y: np.ndarray, first: int, m: int, tau: int):
    """The windows of ``tau`` steps in a block: squared range and squares of residuals of those that lie in it
    whole, summed, and (window, sum of y, sum of place times y) of the parts of others. ``m`` is the series' length."""
    y = y[:max(0, m // tau * tau - first)]
    s = -(-first // tau)
    k = max(0, (first + len(y)) // tau - s)
    begin = min(s * tau - first, len(y))
    whole = y[begin:begin + k * tau].reshape(k, tau)
    res = _line_residuals(whole, np.arange(tau, dtype=float))
    parts = []
    for seg, at, part in ((s - 1, first, y[:begin]), (s + k, first + begin + k * tau, y[begin + k * tau:])):
        if len(part):
            parts.append((seg, part.sum(), (_places(seg, tau, at, len(part)) * part).sum()))
    return k, (np.ptp(res, axis=1) ** 2).sum() if k else 0.0, (res ** 2).sum(), parts


def _block_windows(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            for tau in fluctuation_scales(r.n):
                for lag in LAGS:
                    first = -(-r.t0 // lag)
                    k, span, ss, parts = _windows(np.asarray(r.c[lag - 1])[first * lag - r.t0::lag], first, r.n // lag, tau)
                    out += [(*r[:2], r.blk, r.n, lag, tau, seg, a, b) for seg, a, b in [(-1, span, ss)][:k] + parts]
        yield pd.DataFrame(out, columns=[*K, "blk", "n", "lag", "tau", "seg", "a", "b"])


def _part_residuals(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            for q in r.lines:
                lag, tau, seg = q["lag"], q["tau"], q["seg"]
                first = -(-r.t0 // lag)
                y = np.asarray(r.c[lag - 1])[first * lag - r.t0::lag]
                lo = max(0, seg * tau - first)
                y = y[lo:max(0, (seg + 1) * tau - first)]
                res = y - q["mean"] - q["slope"] * _places(seg, tau, first + lo, len(y))
                out.append((*r[:2], r.n, lag, tau, seg, res.max(), res.min(), (res ** 2).sum()))
        yield pd.DataFrame(out, columns=[*K, "n", "lag", "tau", "seg", "hi", "lo", "ss"])


def fluctuation(df: DataFrame) -> DataFrame:
    """Where the fluctuation of the running sum, as a curve over window lengths, is best split in two lines.

    Running sums come from time blocks. Windows inside one block are settled there; those that cross blocks
    send two sums per block, get their line back and send their residuals' extremes and squares, so a task holds
    one block of a series. Series too short for twelve scales get 0.
    """
    ids = key_schema(df, K)
    sums = prefix_sums(with_stats(df, n=F.count("t")), {"c1": F.col("value"), "c2": F.when(F.col("t") % 2 == 0, F.col("value")).otherwise(0.0)})
    steps = F.array_sort(F.collect_list(F.struct("t", "c1", "c2")))
    rows = sums.where("n >= 10").groupBy(*K, block_of("t").alias("blk")).agg(F.max("n").alias("n"), steps.alias("p"))
    rows = rows.select(*K, "blk", "n", F.col("p")[0]["t"].alias("t0"), F.array(*[F.col(f"p.c{k}") for k in LAGS]).alias("c"))
    # few bytes but much work per row: a given number of partitions is not lowered by size
    rows = cut_lineage(rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *K, "blk"))

    g = [*K, "n", "lag", "tau"]
    found = cut_lineage(rows.mapInPandas(_block_windows, f"{ids}, blk bigint, n bigint, lag int, tau int, seg bigint, a double, b double"))
    cut, tau = found.where("seg >= 0"), F.col("tau").cast("double")
    line = cut.groupBy(*g, "seg").agg((F.sum("a") / tau).alias("mean"), (F.sum("b") * 12 / (tau * (tau * tau - 1))).alias("slope"))
    lines = cut.select(*g, "seg", "blk").join(line, [*g, "seg"]).groupBy(*K, "blk").agg(
        F.collect_list(F.struct("lag", "tau", "seg", "mean", "slope")).alias("lines"))  # at most two windows per scale and lag
    res = rows.join(lines, [*K, "blk"]).select(*K, "n", "t0", "c", "lines").mapInPandas(
        _part_residuals, f"{ids}, n bigint, lag int, tau int, seg bigint, hi double, lo double, ss double")
    res = res.groupBy(*g, "seg").agg((F.max("hi") - F.min("lo")).alias("span"), F.sum("ss").alias("b")).select(*g, (F.col("span") * F.col("span")).alias("a"), "b")

    size = F.floor(F.floor(F.col("n") / F.col("lag")) / F.col("tau"))
    curve = found.where("seg < 0").select(*g, "a", "b").unionAll(res).groupBy(*g).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    curve = curve.select(*K, "lag", "tau", F.sqrt(F.when(F.col("lag") == 1, F.col("a") / size).otherwise(F.col("b") / (size * F.col("tau")))).alias("f"))
    curve = curve.groupBy(*K, "lag").agg(F.array_sort(F.collect_list(F.struct("tau", "f"))).alias("c"))  # at most TAU_STEPS entries
    curve = curve.where(F.size("c") >= 2 * MIN_POINTS).select(
        *K, "lag", F.concat(F.transform("c", lambda q: q["tau"].cast("double")), F.transform("c", lambda q: q["f"])).alias("v"))
    split = map_arrays(curve, "p", _best_split, "v").groupBy(*K).agg(*[F.max(F.when(F.col("lag") == k, F.col("p")[0])).alias(f"p{k}") for k in LAGS])
    w = df.select(*K).distinct().join(split, K, "left")
    return to_long(w, {"SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": F.coalesce("p1", F.lit(0.0)), "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": F.coalesce("p2", F.lit(0.0))})


def _lag_products(steps: int):
    """Sums of products of two blocks' values at every lag from 1 to ``top``; block pairs of one distance share a spectrum."""
    def run(batches):
        for pdf in batches:
            spectra, top = {}, {}
            for r in pdf.itertuples(index=False):
                m = min(steps, r.n)
                size = 1 << (2 * m - 1).bit_length()
                key = (*r[:2], r.d, m, size)
                spectra[key] = spectra.get(key, 0) + np.conj(np.fft.rfft(r.a, size)) * np.fft.rfft(r.b, size)
                top[key] = r.top
            out = []
            for key, p in spectra.items():
                *ids, d, m, size = key
                lag = np.arange(max(1, d * steps - m + 1), min(top[key], d * steps + m - 1) + 1)
                out.append((ids, lag, np.fft.irfft(p, size)[lag - d * steps]))
            if out:
                ids, lags, sums = zip(*out)
                each = [len(x) for x in lags]
                named = {k: np.repeat(np.array([i[j] for i in ids]), each) for j, k in enumerate(K)}
                yield pd.DataFrame({**named, "lag": np.concatenate(lags), "s": np.concatenate(sums)})
    return run


def lag_sums(df: DataFrame, top: Column) -> DataFrame:
    """(dataset, series_id, lag, s): the sum of y(t) * y(t + lag) for the lags from 1 to ``top``.

    ``df`` has the columns t (0..n-1), n and y. Pairs of time blocks no further apart than ``top`` meet; a task
    adds the products of their spectra per distance and sends two values per lag.
    """
    steps = blocks.STEPS
    b = df.groupBy(*K, block_of("t").alias("blk")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("t", "y"))).alias("p"))
    b = b.select(*K, "blk", "n", F.col("p.y").alias("y"))
    # few bytes but much work per row: a given number of partitions is not lowered by size
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = F.least(F.floor((top + steps - 1) / steps), F.floor((F.col("n") - 1) / steps) - F.col("blk"))
    left = b.select(*K, "blk", "n", top.cast("bigint").alias("top"), F.col("y").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), apart.cast("bigint"))).alias("d"))
    left = left.withColumn("blk", F.col("blk") + F.col("d")).repartition(parts, *K, "blk")
    pairs = left.join(b.select(*K, "blk", F.col("y").alias("b")), [*K, "blk"]).select(*K, "n", "top", "d", "a", "b")
    part = pairs.mapInPandas(_lag_products(steps), f"{key_schema(df, K)}, lag bigint, s double")
    return part.groupBy(*K, "lag").agg(F.sum("s").alias("s"))


def periodicity(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """First peak of the autocovariance that rises above the trough before it
    (after removing a linear trend); 0 if there is none."""
    t, v = F.col("t"), F.col("value")
    fit = with_stats(df, n=F.count("t"), mt=F.avg("t"), mv=F.avg("value"), slope=F.covar_pop("t", "value") / F.nullif(F.var_pop("t"), F.lit(0.0)))
    flat = fit.select(*K, "t", "n", (v - F.col("mv") - F.coalesce("slope", F.lit(0.0)) * (t - F.col("mt"))).alias("y"))
    n = df.groupBy(*K).agg(F.count("t").alias("n"))
    c = lag_sums(flat, F.ceil(F.col("n") / 3)).join(n, K).select(*K, (F.col("lag") - 1).alias("i"), (F.col("s") / F.nullif(F.col("n") - F.col("lag"), F.lit(0))).alias("c"))
    c = neighbours(c, {"before": lambda w: F.lag("c").over(w), "after": lambda w: F.lead("c").over(w)}, 1, 1, order="i")
    trough = F.when((F.col("c") < F.col("before")) & (F.col("c") < F.col("after")), F.col("c"))
    c = carry(c.withColumn("trough", trough), "trough", order="i")
    peak = (F.col("c") > F.col("before")) & (F.col("c") > F.col("after")) & (F.col("c") - F.col("prev.v") >= threshold) & (F.col("c") >= 0)
    first = c.where(peak).groupBy(*K).agg(F.min("i").alias("i"))
    return to_long(n.join(first, K, "left"), {"PD_PeriodicityWang_th0_01": F.coalesce("i", F.lit(0))})

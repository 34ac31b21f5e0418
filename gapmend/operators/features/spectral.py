"""Fourier and wavelet features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gapmend.functions.columns import div
from gapmend.operators.features.common import K, arrays, map_arrays, to_long, with_stats

WIDTHS = [2, 5, 10, 20]
CWT_COEFFS = 15
WELCH_SEGMENT = 256


def fft_coefficients(df: DataFrame, n_coeff: int = 8) -> DataFrame:
    """Real and imaginary part, modulus and angle (degrees) of the first coefficients.

    Plain sums, so a series is aggregated map-side whatever its length.
    """
    c = with_stats(df, n=F.count("value"))
    ang = lambda k: F.lit(2 * math.pi * k) * F.col("t") / F.col("n")
    w = c.groupBy(*K).agg(*[F.sum(F.col("value") * F.cos(ang(k))).alias(f"re{k}") for k in range(n_coeff)],
                          *[(-F.sum(F.col("value") * F.sin(ang(k)))).alias(f"im{k}") for k in range(n_coeff)])
    out = {}
    for k in range(n_coeff):
        re, im = F.round(f"re{k}", 9) + F.lit(0.0), F.round(f"im{k}", 9) + F.lit(0.0)
        out[f'fft_coefficient__attr_"real"__coeff_{k}'] = re
        out[f'fft_coefficient__attr_"imag"__coeff_{k}'] = im
        out[f'fft_coefficient__attr_"abs"__coeff_{k}'] = F.sqrt(re * re + im * im)
        out[f'fft_coefficient__attr_"angle"__coeff_{k}'] = F.degrees(F.atan2(im, re))
    return to_long(w, out)


def magnitudes(df: DataFrame) -> DataFrame:
    """(dataset, series_id, n, k, mag): modulus of every real-FFT coefficient."""
    out = map_arrays(arrays(df), "m", lambda x: np.abs(np.fft.rfft(x)))
    return out.select(*K, "n", F.posexplode("m").alias("k", "mag"))


def fft_aggregated(df: DataFrame) -> DataFrame:
    """Centroid, variance, skew and kurtosis of the absolute spectrum."""
    s = magnitudes(df)
    k, m = F.col("k").cast("double"), F.col("mag")
    w = s.groupBy(*K).agg(*[div(F.sum(m * F.pow(k, F.lit(p))), F.sum(m)).alias(f"m{p}") for p in (1, 2, 3, 4)])
    m1, m2, m3, m4 = (F.col(f"m{p}") for p in (1, 2, 3, 4))
    var = m2 - m1 * m1
    wide = var >= 0.5
    skew = F.when(wide, (m3 - 3 * m1 * var - m1 * m1 * m1) / F.pow(var, F.lit(1.5)))
    kurt = F.when(wide, (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1 * m1 * m1 * m1) / (var * var))
    name = 'fft_aggregated__aggtype_"%s"'
    return to_long(w, {name % "centroid": m1, name % "variance": var, name % "skew": skew, name % "kurtosis": kurt})


def welch(df: DataFrame, coeffs=(2, 5)) -> DataFrame:
    """Power density at a few bins: Hann window, half-overlapping segments, mean removed."""
    c = with_stats(df, n=F.count("value"))
    size = F.least(F.col("n"), F.lit(WELCH_SEGMENT))
    hop = size - F.floor(size / 2)
    last = F.floor((F.col("n") - size) / hop)
    lo = F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / hop)).cast("bigint")
    hi = F.least(last, F.floor(F.col("t") / hop)).cast("bigint")
    seg = c.withColumn("size", size).where(lo <= hi).withColumn("seg", F.explode(F.sequence(lo, hi)))
    seg = seg.withColumn("u", F.col("t") - F.col("seg") * hop)
    mean = seg.groupBy(*K, "seg").agg(F.avg("value").alias("mu"))
    seg = seg.join(mean, [*K, "seg"])
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("u") / F.col("size"))
    y = (F.col("value") - F.col("mu")) * hann
    aggs = [F.max("size").alias("size"), F.sum(hann * hann).alias("ww")]
    for k in coeffs:
        a = F.lit(2 * math.pi * k) * F.col("u") / F.col("size")
        aggs += [F.sum(y * F.cos(a)).alias(f"re{k}"), F.sum(y * F.sin(a)).alias(f"im{k}")]
    g = seg.groupBy(*K, "seg").agg(*aggs)
    side = lambda k: F.when(F.col("size") == 2 * k, 1.0).otherwise(2.0)
    w = g.groupBy(*K).agg(*[F.avg(F.when(F.col("size") >= 2 * k, side(k) * (
        F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}")) / F.col("ww"))).alias(f"p{k}") for k in coeffs])
    return to_long(w, {f"spkt_welch_density__coeff_{k}": F.col(f"p{k}") for k in coeffs})


def cwt(df: DataFrame) -> DataFrame:
    """First coefficients of the convolution with Ricker wavelets of four widths.

    The wavelet is a closed expression of t, so nothing is joined, and only the
    steps that reach the first coefficients are read.
    """
    n = df.groupBy(*K).agg(F.count("value").alias("n"))
    reach = CWT_COEFFS + max(WIDTHS) * 10 // 2 + 1
    c = df.where(F.col("t") < reach).join(n, K)
    aggs, out = [], {}
    for w in WIDTHS:
        points = F.least(F.lit(10 * w), F.col("n"))
        amp = 2.0 / (math.sqrt(3.0 * w) * math.pi ** 0.25)
        for i in range(CWT_COEFFS):
            at = F.lit(i) + F.floor((points - 1) / 2) - F.col("t")
            v = at - (points - 1) / 2.0
            z = v * v / float(w * w)
            wave = F.lit(amp) * (1.0 - z) * F.exp(-z / 2.0)
            name = f"c{w}_{i}"
            aggs.append(F.sum(F.when((at >= 0) & (at < points), F.col("value") * wave)).alias(name))
            out[f"cwt_coefficients__coeff_{i}__w_{w}__widths_(2, 5, 10, 20)"] = F.col(name)
    return to_long(c.groupBy(*K).agg(*aggs), out)

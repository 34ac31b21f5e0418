"""Entropy and complexity features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gapmend.operators.blocks import neighbours
from gapmend.operators.features.common import K, arrays, map_arrays, to_long, with_stats

LZ_BINS = [2, 3, 5, 10, 100]
APEN_R = [0.1, 0.3, 0.5, 0.7, 0.9]
APEN_ROWS = 512
# fixed values: shares of the first digits 1-9, log10(1 + 1/d)
BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin; the last one is closed; 0 for a constant series."""
    width = F.nullif((hi - lo) / bins, F.lit(0.0))
    return F.coalesce(F.least(F.floor((value - lo) / width), F.lit(bins - 1)), F.lit(0))


def entropy_of(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """-sum p ln p over the rows ``c`` of each key."""
    c = F.col("c").cast("double")
    return counts.groupBy(*keys).agg((F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)).alias(name))


def binned(df: DataFrame, bins: int = 10) -> DataFrame:
    c = with_stats(df, lo=F.min("value"), hi=F.max("value"))
    h = c.groupBy(*K, bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return to_long(entropy_of(h, K, "e"), {f"binned_entropy__max_bins_{bins}": F.col("e")})


def permutation(df: DataFrame, dims=(3, 4, 5, 6, 7)) -> DataFrame:
    """Entropy of the order patterns of consecutive values.

    A pattern is the bit set of its pairwise comparisons, an integer expression.
    """
    top = max(dims)
    d = neighbours(df, {f"x{i}": (lambda w, i=i: F.lead("value", i).over(w)) for i in range(1, top)}, 0, top - 1)
    x = [F.col("value")] + [F.col(f"x{i}") for i in range(1, top)]
    codes = []
    for dim in dims:
        code, bit = F.lit(0).cast("bigint"), 1
        for j in range(1, dim):
            for i in range(j):
                code = code + F.when(x[i] <= x[j], F.lit(bit)).otherwise(F.lit(0))
                bit *= 2
        codes.append(F.when(x[dim - 1].isNotNull(), F.struct(F.lit(dim).alias("dim"), code.alias("code"))))
    p = d.select(*K, F.explode(F.array_compact(F.array(*codes))).alias("p")).select(*K, "p.dim", "p.code")
    h = p.groupBy(*K, "dim", "code").agg(F.count(F.lit(1)).alias("c"))
    e = entropy_of(h, [*K, "dim"], "value")
    return e.select(*K, F.format_string("permutation_entropy__dimension_%d__tau_1", "dim").alias("feature"), "value")


def approximate(df: DataFrame, m: int = 2, rs=tuple(APEN_R)) -> DataFrame:
    """Approximate entropy: phi(m) - phi(m + 1) for several tolerances r * sigma.

    The template rows of a series are split into blocks of ``APEN_ROWS``; a task
    compares one block with the series and returns one partial sum per (m, r).
    """
    a = arrays(df).withColumn("blk", F.explode(F.sequence(
        F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / APEN_ROWS).cast("int"))))

    def run(batches):
        for pdf in batches:
            out = []
            for ds, sid, x, blk in zip(pdf["dataset"], pdf["series_id"], pdf["x"], pdf["blk"]):
                x = np.asarray(x, dtype=float)
                tol = np.array(rs) * x.std()
                for dim in (m, m + 1):
                    if len(x) < dim + 1:
                        continue
                    win = np.lib.stride_tricks.sliding_window_view(x, dim)
                    total = np.zeros(len(rs))
                    for i in range(blk * APEN_ROWS, min((blk + 1) * APEN_ROWS, len(win))):
                        dist = np.abs(win - win[i]).max(axis=1)
                        near = (dist[None, :] <= tol[:, None]).sum(axis=1)
                        total += np.log(near / len(win))
                    out += [(ds, sid, dim, j, float(t), len(win)) for j, t in enumerate(total)]
            yield pd.DataFrame(out, columns=["dataset", "series_id", "dim", "j", "total", "n"])

    part = a.mapInPandas(run, "dataset string, series_id bigint, dim int, j int, total double, n bigint")
    w = part.groupBy(*K, "j").agg(
        F.sum(F.when(F.col("dim") == m, F.col("total") / F.col("n"))).alias("a"),
        F.sum(F.when(F.col("dim") == m + 1, F.col("total") / F.col("n"))).alias("b"))
    name = F.element_at(F.array(*[F.lit(f"approximate_entropy__m_{m}__r_{r}") for r in rs]), F.col("j") + 1)
    return w.select(*K, name.alias("feature"), F.abs(F.col("a") - F.col("b")).alias("value"))


def _lz_share(x: np.ndarray, bins: int) -> float:
    edges = np.linspace(x.min(), x.max(), bins + 1)[1:]
    letters = np.searchsorted(edges, x, side="left").tolist()
    seen, word = set(), ()
    for c in letters:
        word += (c,)
        if word not in seen:
            seen.add(word)
            word = ()
    return len(seen) / len(letters)


def lempel_ziv(df: DataFrame) -> DataFrame:
    """Number of distinct words of a greedy parse of the binned series, per step."""
    a = map_arrays(arrays(df), "lz", lambda x: np.array([_lz_share(x, b) for b in LZ_BINS]))
    return to_long(a, {f"lempel_ziv_complexity__bins_{b}": F.col("lz")[i] for i, b in enumerate(LZ_BINS)})


def benford(df: DataFrame) -> DataFrame:
    """Correlation of the first-digit shares with Benford's law."""
    digit = F.expr("try_cast(regexp_extract(CAST(abs(value) AS STRING), '[1-9]', 0) AS INT)")
    w = df.groupBy(*K).agg(*[F.avg(F.coalesce(digit == i, F.lit(False)).cast("double")).alias(f"d{i}") for i in range(1, 10)])
    mean = sum((F.col(f"d{i}") for i in range(1, 10)), F.lit(0.0)) / 9
    b0 = sum(BENFORD) / 9
    sxy = sum(((F.col(f"d{i}") - F.col("mean")) * (b - b0) for i, b in enumerate(BENFORD, 1)), F.lit(0.0))
    sxx = sum(((F.col(f"d{i}") - F.col("mean")) * (F.col(f"d{i}") - F.col("mean")) for i in range(1, 10)), F.lit(0.0))
    syy = sum((b - b0) ** 2 for b in BENFORD)
    w = w.withColumn("mean", mean)
    return to_long(w, {"benford_correlation": F.when(sxx > 1e-12, sxy / F.sqrt(sxx * syy))})

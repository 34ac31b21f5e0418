"""Shared steps of the feature operators.

Input is a dense long series ``(dataset, series_id, t, value)`` with t = 0..n-1;
output is ``(dataset, series_id, feature, value)``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gapmend.functions.columns import SERIES

K = SERIES
BATCH_VALUES = 1 << 17


def to_long(wide: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """One row per feature from one wide row per series, without a shuffle."""
    packed = F.array(*[F.struct(F.lit(n).alias("feature"), e.cast("double").alias("value")) for n, e in exprs.items()])
    return wide.select(*K, F.explode(packed).alias("f")).select(*K, "f.feature", "f.value")


def with_stats(df: DataFrame, **aggs: Column) -> DataFrame:
    """Join per-series aggregates to the rows."""
    return df.join(df.groupBy(*K).agg(*[c.alias(n) for n, c in aggs.items()]), K)


def centred(df: DataFrame) -> DataFrame:
    """Rows with n, mu, sd (population) and xc = value - mu."""
    out = with_stats(df, n=F.count("value"), mu=F.avg("value"), sd=F.stddev_pop("value"))
    return out.withColumn("xc", F.col("value") - F.col("mu"))


def chunk_of(t: Column, n: Column, parts: int) -> Column:
    """Index of the near-equal chunk of step t; the first (n mod parts) are longer."""
    each = F.floor(n / parts)
    extra = n - each * parts
    cut = extra * (each + 1)
    tail = F.floor((t - cut) / F.nullif(each, F.lit(0)))
    return F.when(t < cut, F.floor(t / (each + 1))).otherwise(extra + tail)


def regression(wide: DataFrame, n: Column, sx: Column, sxx: Column, sy: Column, syy: Column, sxy: Column):
    """slope, intercept, rvalue, stderr of y on x from sums; r is 0 for constant y."""
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    cxy = sxy - sx * sy / n
    slope = cxy / F.nullif(vx, F.lit(0.0))
    tiny = vy <= F.lit(1e-12) * F.greatest(F.abs(syy), F.lit(1.0))
    r = F.when(tiny, 0.0).otherwise(cxy / F.sqrt(F.nullif(vx, F.lit(0.0)) * F.nullif(vy, F.lit(0.0))))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    resid = F.greatest((F.lit(1.0) - r * r) * vy, F.lit(0.0))
    stderr = F.sqrt(resid / F.nullif(vx, F.lit(0.0)) / F.nullif(n - 2, F.lit(0.0)))
    return slope, (sy - slope * sx) / n, r, stderr


def map_arrays(df: DataFrame, name: str, fn: Callable[[np.ndarray], np.ndarray], source: str = "x", keep: bool = True) -> DataFrame:
    """Add an array column computed by numpy from one array per series; without ``keep`` the source does not come back.

    A few rows at a time leave the task, of at most ``BATCH_VALUES`` source values unless one row has more.
    """
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if keep or f.name != source)

    def run(batches):
        for pdf in batches:
            rest = pdf if keep else pdf.drop(columns=source)
            step = max(1, BATCH_VALUES // max(1, pdf[source].map(len).max())) if len(pdf) else 1
            for i in range(0, len(pdf), step):
                yield rest.iloc[i:i + step].assign(**{name: [fn(np.asarray(v, dtype=float)) for v in pdf[source].iloc[i:i + step]]})
    return df.mapInPandas(run, f"{head}, `{name}` array<double>")


def arrays(df: DataFrame) -> DataFrame:
    """(dataset, series_id, x, n): one ordered array per series."""
    return df.groupBy(*K).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("t", "value"))), lambda v: v["value"]).alias("x")).withColumn("n", F.size("x"))

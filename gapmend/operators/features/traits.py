"""Cluster traits: length, irregularity (share of anomalous steps) and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapmend.operators.blocks import neighbours
from gapmend.operators.correlate import pairwise_corr
from gapmend.operators.features.common import K

CLUSTER = ["dataset", "cluster_id"]


def length(df: DataFrame) -> DataFrame:
    return df.groupBy(*K).agg(F.count("value").alias("length"))


def _quantiles(df: DataFrame, col: str, qs: list[float]) -> DataFrame:
    return df.groupBy(*K).agg(F.percentile(col, F.array(*[F.lit(q) for q in qs])).alias("q"))


def anomaly_quantile(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    out = df.join(_quantiles(df, "value", [low, high]), K)
    return out.withColumn("anomaly", (F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[1])).drop("q")


def anomaly_iqr(df: DataFrame, c: float = 1.5) -> DataFrame:
    out = df.join(_quantiles(df, "value", [0.25, 0.75]), K)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    span = (q3 - q1) * c
    return out.withColumn("anomaly", (F.col("value") < q1 - span) | (F.col("value") > q3 + span)).drop("q")


def anomaly_persist(df: DataFrame, c: float = 3.0) -> DataFrame:
    """Jumps up from the previous value that are IQR outliers among all jumps."""
    d = neighbours(df, {"jump": lambda w: F.col("value") - F.lag("value").over(w)}, 1, 0)
    out = d.join(_quantiles(d, "jump", [0.25, 0.75]), K)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return out.withColumn("anomaly", F.coalesce(F.col("jump") > q3 + (q3 - q1) * c, F.lit(False))).drop("q", "jump")


def esd_critical(n: Column, alpha: float = 0.3) -> Column:
    """Critical value of the largest studentised deviate for n points.

    The Student quantile at 1 - alpha / (2 n) comes from a normal quantile
    (Abramowitz & Stegun 26.2.23) with the Cornish-Fisher correction.
    """
    p = F.lit(alpha) / (2 * n)
    # fixed values of the normal quantile approximation
    s = F.sqrt(-2 * F.log(p))
    z = s - (2.515517 + 0.802853 * s + 0.010328 * s * s) / (1 + 1.432788 * s + 0.189269 * s * s + 0.001308 * s * s * s)
    v = n - 2.0
    z2 = z * z
    t = z + z * (z2 + 1) / (4 * v) + z * (5 * z2 * z2 + 16 * z2 + 3) / (96 * v * v)
    return (n - 1) * t / F.sqrt(n * (v + t * t))


def anomaly_esd(df: DataFrame, alpha: float = 0.3) -> DataFrame:
    """One-pass extreme studentised deviate test (no iterative removal)."""
    stats = df.groupBy(*K).agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    stats = stats.select(*K, "mu", "sd", F.when(F.col("n") > 3, esd_critical(F.col("n"), alpha)).alias("crit"))
    out = df.join(stats, K)
    return out.withColumn("anomaly", F.coalesce(F.abs(F.col("value") - F.col("mu")) > F.col("crit") * F.col("sd"), F.lit(False))).drop("mu", "sd", "crit")


def irregularity(df: DataFrame) -> DataFrame:
    """Share of time steps that any detector flags in any series of the cluster.

    The four detectors share one pass for the statistics; flags are combined per
    (cluster, step) with partial aggregation.
    """
    d = neighbours(df, {"jump": lambda w: F.col("value") - F.lag("value").over(w)}, 1, 0)
    s = d.groupBy(*K).agg(
        F.percentile("value", F.array(*[F.lit(q) for q in (0.01, 0.25, 0.75, 0.99)])).alias("q"),
        F.percentile("jump", F.array(F.lit(0.25), F.lit(0.75))).alias("j"),
        F.count("value").cast("double").alias("n"), F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    s = s.withColumn("crit", F.when(F.col("n") > 3, esd_critical(F.col("n"))))
    q, j, v = F.col("q"), F.col("j"), F.col("value")
    span = (q[2] - q[1]) * 1.5
    flag = ((v < q[0]) | (v > q[3]) | (v < q[1] - span) | (v > q[2] + span)
            | F.coalesce(F.col("jump") > j[1] + (j[1] - j[0]) * 3.0, F.lit(False))
            | F.coalesce(F.abs(v - F.col("mu")) > F.col("crit") * F.col("sd"), F.lit(False)))
    steps = d.join(s, K).groupBy(*CLUSTER, "t").agg(F.bool_or(flag).alias("hit"))
    return steps.groupBy(*CLUSTER).agg(
        F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("double")).alias("irregularity"), F.count(F.lit(1)).alias("length"))


def cluster_traits(df: DataFrame) -> DataFrame:
    """(dataset, cluster_id, length, irregularity, correlation): the correlations of
    all pairs of the cluster, ordered by pair; undefined ones are left out."""
    corr = pairwise_corr(df).where("corr IS NOT NULL").groupBy(*CLUSTER).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("a", "b", "corr"))), lambda p: p["corr"]).alias("correlation"))
    return irregularity(df).join(corr, CLUSTER, "left").withColumn(
        "correlation", F.coalesce("correlation", F.array().cast("array<double>")))


def summarise_traits(traits: DataFrame) -> DataFrame:
    """Population standard deviation and median of the correlations."""
    c, n = F.col("correlation"), F.size("correlation")
    mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    out = traits.withColumn("mean_corr", mean).withColumn("s", F.array_sort(c))
    var = F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - F.col("mean_corr")) * (x - F.col("mean_corr"))) / F.nullif(n, F.lit(0))
    mid = lambda k: F.try_element_at("s", F.greatest(F.floor((n + k) / 2).cast("int"), F.lit(1)))
    return out.select(*CLUSTER, "length", "irregularity", F.sqrt(var).alias("std_corr"), ((mid(1) + mid(2)) / 2).alias("median_corr"))

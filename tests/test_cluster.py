"""Clustering: partitions, recovered groups, merges and constraints."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.operators import cluster as C, correlate as R


@pytest.fixture(scope="module")
def shapes(spark):
    """Thirty series: three shapes, shifted and noisy."""
    rng = np.random.default_rng(1)
    t = np.arange(64)
    forms = [np.exp(-((t - 20) / 4.0) ** 2), np.sin(t / 3.0), np.where((t > 15) & (t < 35), 1.0, -1.0)]
    rows = []
    for i in range(30):
        x = np.roll(forms[i % 3], int(rng.integers(-4, 5))) + rng.normal(scale=0.05, size=64)
        rows += [("s", i, int(s), float(v)) for s, v in zip(t, x)]
    return spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], set()).add(r["series_id"])
    return out


def partition(df, n):
    g = groups(df)
    assert sum(len(v) for v in g.values()) == n and len(set().union(*g.values())) == n
    return g


def test_kshape_recovers_shapes(shapes):
    arr = C.z_arrays(shapes).select("dataset", "series_id", "vals", F.lit(3).cast("bigint").alias("k"), F.lit(0).alias("seed"))
    best = 0
    for seed in range(3):
        g = partition(C.kshape(arr.withColumn("seed", F.lit(seed)), ["dataset"], 8), 30)
        best = max(best, sum(max(sum(i % 3 == s for i in v) for s in range(3)) for v in g.values()))
    assert best >= 27


def test_kmeans_partition(shapes):
    assert len(partition(C.kmeans_series(shapes, 3), 30)) == 3


def test_incremental_partition(shapes):
    g = partition(C.incremental_cluster(shapes, 0.5, 0.9, max_rounds=4), 30)
    assert len(g) >= 3


def test_merge_joins_equal_shapes(spark, shapes):
    start = shapes.select("dataset", "series_id").distinct().withColumn("cluster_id", F.col("series_id"))
    g = partition(C.merge_clusters(shapes, start, 0.8, max_rounds=3), 30)
    assert len(g) < 30 and all(len({i % 3 for i in v}) == 1 for v in g.values())
    g = partition(C.merge_clusters_ratio(shapes, start, 0.8, max_rounds=1), 30)
    assert len(g) < 30


def test_constraints(shapes):
    start = shapes.select("dataset", "series_id").distinct().withColumn("cluster_id", F.when(F.col("series_id") < 3, F.col("series_id")).otherwise(9))
    g = partition(C.apply_constraints(shapes, start), 30)
    assert all(5 <= len(v) <= 15 for v in g.values())


def test_best_rerun_and_gridsearch(shapes):
    partition(C.best_rerun(shapes, 3, 2), 30)
    row = C.cluster_gridsearch(shapes, [2, 3], 1).first()
    assert row["k"] in (2, 3) and 0 < row["score"] <= 1
    assert C.cluster_gridsearch(shapes, [2], 1, enough=0.0).first()["k"] == 1


def test_mean_corr_equals_pair_average(shapes):
    one = shapes.withColumn("cluster_id", F.lit(0).cast("bigint"))
    arr = {}
    for r in shapes.collect():
        arr.setdefault(r["series_id"], {})[r["t"]] = r["value"]
    x = np.array([[v[t] for t in range(64)] for _, v in sorted(arr.items())])
    c = np.corrcoef(x)
    want = np.mean([c[i, j] for i, j in itertools.combinations(range(30), 2)])
    assert R.mean_corr(one).first()["mean_corr"] == pytest.approx(want, abs=1e-9)


def test_merges_read_the_series_once(spark):
    """Merging builds its series once, however many statistics it takes from them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [("d", s, t, float((t * (1 + s % 3) + s * s) % 11)) for s in range(12) for t in range(24)]
    df = spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double").mapInPandas(
        count, "dataset string, series_id bigint, t bigint, value double")
    asg = spark.createDataFrame([("d", s, s // 3) for s in range(12)], "dataset string, series_id bigint, cluster_id bigint")
    for merge in (C.merge_clusters, C.merge_clusters_ratio):
        before = seen.value
        assert merge(df, asg, 0.05).count() == 12
        assert seen.value - before == len(rows), merge.__name__

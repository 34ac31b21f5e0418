"""Clustering loops run to their fixed point, and name what a bound has left open."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.operators import cluster as C


@pytest.fixture(scope="module")
def chain(spark):
    """Six noisy copies of one shape."""
    rng = np.random.default_rng(6)
    x = np.sin(np.arange(48) / 3.0)
    rows = [("s", 2 * i, int(t), float(v)) for i in range(6) for t, v in enumerate(x + rng.normal(scale=0.1, size=48))]
    return spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double").persist()


def alone(df):
    return df.select("dataset", "series_id").distinct().withColumn("cluster_id", F.col("series_id"))


def test_merge_ends_at_the_fixed_point(chain):
    got = C.merge_clusters_ratio(chain, alone(chain), 0.5)
    left = C.similar_clusters(C.cluster_stats(chain.join(got, ["dataset", "series_id"])), 0.5)
    ok = lambda a, b: (F.col("phi_union") / F.col(f"phi_{a}") >= F.when(F.col(f"n_{a}") > 1, 0.8).otherwise(0.75))
    assert left.where(ok("a", "b") | ok("b", "a")).isEmpty()
    assert got.select("cluster_id").distinct().count() == 1


def test_open_clusters_are_named(chain):
    rows = C.incremental_cluster(chain, 0.999, 0.999, max_rounds=1).collect()
    assert len(rows) == 6 and not any(r.converged for r in rows)


def test_kshape_says_whether_labels_settled(chain):
    arr = C.z_arrays(chain).select("dataset", "series_id", "vals", F.lit(3).cast("bigint").alias("k"), F.lit(0).alias("seed"))
    assert {r.converged for r in C.kshape(arr, ["dataset"], 1, flag=True).collect()} == {False}
    assert {r.converged for r in C.kshape(arr, ["dataset"], flag=True).collect()} == {True}


def test_small_data_set_keeps_its_series(spark):
    rows = [("tiny", i, t, float(t * i % 5)) for i in (1, 2) for t in range(20)]
    df = spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double")
    assert [(r.dataset, r.k) for r in C.cluster_gridsearch(df).collect()] == [("tiny", 1)]

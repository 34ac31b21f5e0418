"""Series cover the steps of their data; equal ids of different data sets stay apart."""

import numpy as np
from pyspark.sql import functions as F

from gapmend.operators import blocks, evaluate as E, series
from gapmend.operators.series import explode_large_clusters
from gapmend.sources.tables import series_from_table


def test_steps_outside_any_calendar(spark):
    rows = [(1, -40, 1.0), (1, -38, 2.0), (2, 5, 3.0), (2, 5, 4.0), (3, None, 9.0)]
    df = spark.createDataFrame(rows, "k bigint, s int, v double")
    got = {(r.series_id, r.t): r.value for r in series_from_table(df, "k", F.col("s"), F.sum("v")).collect()}
    assert set(got) == {(k, t) for k in (1, 2) for t in range(-40, 6)}
    assert {x: v for x, v in got.items() if v is not None} == {(1, -40): 1.0, (1, -38): 2.0, (2, 5): 7.0}
    zero = series_from_table(df, "k", F.col("s"), F.sum("v"), fill=0.0, span=(-39, -38)).collect()
    assert sorted((r.series_id, r.t, r.value) for r in zero) == [(1, -39, 0.0), (1, -38, 2.0)]
    assert series_from_table(df.limit(0), "k", F.col("s"), F.sum("v")).count() == 0


def test_chunk_ids_do_not_collide(spark):
    rows = [("a", i, 0) for i in range(40)] + [("a", 100 + i, 1) for i in range(20)] + [("a", 200, 2), ("b", 1, 0)]
    got = explode_large_clusters(spark.createDataFrame(rows, "dataset string, series_id bigint, cluster_id bigint")).collect()
    old = {(d, s): c for d, s, c in rows}
    back = {}
    for r in got:
        back.setdefault((r.dataset, r.cluster_id), set()).add(old[r.dataset, r.series_id])
    assert all(len(v) == 1 for v in back.values()) and len(got) == len(rows)
    assert max(sum(x.cluster_id == r.cluster_id and x.dataset == r.dataset for x in got) for r in got) <= 15


def test_equal_ids_in_two_data_sets(spark):
    one = [(1, "x", "A", "A", 0.6), (1, "x", "A", "B", 0.4)]
    two = [(1, "x", "A", "A", 0.1), (1, "x", "A", "B", 0.9)]
    cols = "series_id bigint, category string, true_label string, class string, probability double"
    a, b = (spark.createDataFrame(r, cols).withColumn("dataset", F.lit(n)) for r, n in ((one, "a"), (two, "b")))
    both = a.unionByName(b)
    for f in (E.predict_label, E.rank_recommendations, E.true_rank, lambda p: E.soft_vote([p, p])):
        got = sorted(map(str, (r.asDict() for r in f(both).collect())))
        assert got == sorted(str(r.asDict()) for x in (a, b) for r in f(x).collect())


def test_sparse_ids_are_numbered_by_ranges(spark, monkeypatch):
    """Ids of 60 bits far apart: few ranges, none with many rows, the same numbers as a sort gives."""
    monkeypatch.setattr(blocks, "RANGE_ROWS", 100)
    rng = np.random.default_rng(4)
    ids = sorted({(d, int(x)) for d in ("a", "b") for x in rng.integers(-(1 << 60), 1 << 60, size=700 if d == "a" else 40)})
    df = spark.createDataFrame([ids[i] for i in rng.permutation(len(ids))], "dataset string, series_id bigint")
    got = {(r["dataset"], r["series_id"]): r["global_id"] for r in series.global_series_id(df).collect()}
    assert got == {k: i for i, k in enumerate(ids)}
    own = {(r["dataset"], r["series_id"]): r["pos"] for r in blocks.numbered(df, ["dataset"], ["series_id"], "pos").collect()}
    n_a = sum(d == "a" for d, _ in ids)
    assert own == {k: i + 1 - (n_a if k[0] == "b" else 0) for i, k in enumerate(ids)}
    assert series.global_series_id(df.limit(0)).count() == 0

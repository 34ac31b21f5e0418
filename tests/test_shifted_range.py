"""Hidden blocks and lag bounds follow the steps of the data, wherever these start."""

from pyspark.sql import functions as F

from gapmend.operators import impute as I
from gapmend.operators.features import acf


def test_hidden_block_follows_the_data(spark):
    rows = [(d, 0, 1, t, float(t)) for d, lo, n in (("a", 24, 83), ("b", 0, 200)) for t in range(lo, lo + n)]
    df = spark.createDataFrame(rows, "dataset string, cluster_id bigint, series_id bigint, t bigint, value double")
    got = I.mask_miss_perc(df).where("hidden").groupBy("dataset", "miss_perc").agg(F.min("t").alias("lo"), F.count("t").alias("n")).collect()
    assert {(r.dataset, r.miss_perc): (r.lo, r.n) for r in got} == {
        (d, p): (lo + 4, n * p // 100) for d, lo, n in (("a", 24, 83), ("b", 0, 200)) for p in range(10, 90, 10)}


def test_lag_bound_follows_the_data(series, monkeypatch):
    df, _ = series
    asked = []
    real = acf.adf_max_lag
    monkeypatch.setattr(acf, "adf_max_lag", lambda n: asked.append(n) or real(n))
    long = acf.adf(df.where("dataset = 'a' OR t < 40"))
    assert set(asked) == {90, 40} and {r.dataset for r in long.collect()} == {"a", "b"}


def test_lag_bound_as_a_column(spark):
    df = spark.range(1, 5000).withColumn("top", acf._max_lag(F.col("id")))
    assert all(r["top"] == acf.adf_max_lag(r["id"]) for r in df.collect())

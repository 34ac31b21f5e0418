"""Reshaping, joins and identity of series (long form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.functions.columns import BIG, SERIES, div
from gapmend.operators.blocks import numbered, ranked

ID_BUCKET = 10_000


# --- reshaping -------------------------------------------------------------------

def transpose_series(df: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """Wide form with one row per time step and one column per given series, or the
    reverse; in long form rows and columns are just keys."""
    names = [f"t{i}" for i in steps]
    wide = df.groupBy(*SERIES).agg(*[
        F.max(F.when(F.col("t") == i, F.col("value"))).alias(n) for i, n in zip(steps, names)])
    return wide


def series_to_array(df: DataFrame, keys=SERIES, name: str = "vals") -> DataFrame:
    """One array per series, ordered by t."""
    return df.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias(name))


def znormalize(df: DataFrame) -> DataFrame:
    """(x - mean) / population sigma per series; NULL for constant series."""
    stats = df.groupBy(*SERIES).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return df.join(stats, SERIES).withColumn("value", div(F.col("value") - F.col("mu"), F.col("sd"))).drop("mu", "sd")


def suffix_features(df: DataFrame, suffix: str) -> DataFrame:
    """Append the extractor suffix to every feature name (long form)."""
    return df.withColumn("feature", F.concat("feature", F.lit(suffix)))


def _bad(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def drop_null_features(df: DataFrame) -> DataFrame:
    """Drop every feature that is missing for at least one series.

    Missing means NULL, NaN or no row at all.
    """
    n = df.select(*SERIES).distinct().agg(F.count(F.lit(1)).alias("n_series"))
    complete = df.groupBy("feature").agg(
        F.count_if(~_bad(F.col("value"))).alias("n_ok")).join(n, F.col("n_ok") == F.col("n_series")).select("feature")
    return df.join(complete, "feature", "left_semi")


def dropped_share(df: DataFrame) -> DataFrame:
    """How many features ``drop_null_features`` removes, and whether that is > 10 %."""
    n_all = df.select("feature").distinct().agg(F.count(F.lit(1)).alias("n_features"))
    n_kept = drop_null_features(df).select("feature").distinct().agg(F.count(F.lit(1)).alias("n_kept"))
    return n_all.join(n_kept).withColumn("warn", (F.col("n_features") - F.col("n_kept")) * 10 > F.col("n_features"))


def nan_to_num(c: Column) -> Column:
    """NaN and NULL -> 0, infinities -> the largest finite double."""
    inf = float("inf")
    return (F.when(c.isNull() | F.isnan(c), 0.0).when(c == F.lit(inf), BIG)
            .when(c == F.lit(-inf), -BIG).otherwise(c))


def align_features(df: DataFrame, trained: list[str]) -> DataFrame:
    """Wide rows restricted to the trained features, in their order; absent ones are 0."""
    have = set(df.columns)
    return df.select(*SERIES, *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in trained])


def missing_share(columns: list[str], trained: list[str]) -> float:
    """Share of trained features that new data lacks; above 0.2 deserves a warning."""
    return len(set(trained) - set(columns)) / max(len(trained), 1)


def select_feature_list(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.select("feature").distinct(), "feature", "left_semi")


def binarize_traits(df: DataFrame, large: int = 1000, irregular: float = 0.15,
                    mixed: float = 0.05, high: float = 0.85) -> DataFrame:
    """Four 0/1 traits of a cluster from length, irregularity and correlations."""
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return df.select(
        "dataset", "cluster_id",
        flag(F.col("length") >= large).alias("large_ts"),
        flag(F.col("irregularity") > irregular).alias("irregular_ts"),
        flag(F.col("std_corr") > mixed).alias("mixed_corr"),
        flag(F.col("median_corr") > high).alias("high_corr"))


# --- joins and sets --------------------------------------------------------------

def join_training_table(labels: DataFrame, features: list[DataFrame], assignment: DataFrame) -> DataFrame:
    """Outer join of labels, every extractor's features and the assignment by series."""
    out = labels
    for f in [*features, assignment]:
        out = out.join(f, SERIES, "full_outer")
    return out


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def propagate_cluster_label(labels: DataFrame, assignment: DataFrame) -> DataFrame:
    """Give every series the attributes of its cluster."""
    return assignment.join(labels, ["dataset", "cluster_id"])


def cluster_members(df: DataFrame, assignment: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the series of the wanted clusters."""
    ids = assignment.join(wanted.select("dataset", "cluster_id").distinct(), ["dataset", "cluster_id"], "left_semi")
    return df.join(ids, SERIES)


def iter_clusters(assignment: DataFrame) -> DataFrame:
    """Every cluster of every data set with its size and first series."""
    return assignment.groupBy("dataset", "cluster_id").agg(
        F.count(F.lit(1)).alias("n_series"), F.min("series_id").alias("first_series"))


def outside_cluster_counts(assignment: DataFrame) -> DataFrame:
    """Per cluster, the number of series of its data set outside it."""
    per = assignment.groupBy("dataset", "cluster_id").agg(F.count(F.lit(1)).alias("n_in"))
    tot = per.groupBy("dataset").agg(F.sum("n_in").alias("n_all"))
    return per.join(tot, "dataset").select(
        "dataset", "cluster_id", (F.col("n_all") - F.col("n_in")).alias("n_outside"))


def series_outside_cluster(assignment: DataFrame, cluster: DataFrame, arrays: DataFrame | None = None) -> DataFrame:
    """Series of the clusters' data sets that are outside the given clusters.

    ``cluster`` has (dataset, cluster_id), one cluster per data set. With ``arrays``
    (dataset, series_id, vals) membership is by value: a series whose values occur
    more than once in the data set is dropped too.
    """
    inside = cluster.select("dataset", F.col("cluster_id").alias("of_cluster"))
    out = assignment.join(inside, "dataset").where(F.col("cluster_id") != F.col("of_cluster"))
    if arrays is not None:
        # values go through a digest, so that a long array is not a shuffle key
        digest = arrays.select(*SERIES, F.sha2(F.to_json("vals"), 256).alias("h"))
        once = digest.groupBy("dataset", "h").agg(
            F.count(F.lit(1)).alias("n"), F.min("series_id").alias("series_id")).where("n = 1")
        out = out.join(once.select(*SERIES), SERIES, "left_semi")
    return out


def test_membership(df: DataFrame, test_ids: DataFrame, level: str) -> DataFrame:
    """Add ``in_test``; level is clusters, datasets or timeseries."""
    on = {"clusters": ["dataset", "cluster_id"], "datasets": ["dataset"], "timeseries": SERIES}[level]
    marks = test_ids.select(*on).distinct().withColumn("hit", F.lit(True))
    return df.join(marks, on, "left").withColumn("in_test", F.coalesce("hit", F.lit(False))).drop("hit")


def known_label_filter(test: DataFrame, train: DataFrame) -> DataFrame:
    """Keep test rows whose label occurs in training."""
    return test.join(train.select("label").distinct(), "label", "left_semi")


def category_join(df: DataFrame, meta: DataFrame) -> DataFrame:
    return df.join(meta.select("dataset", "category"), "dataset")


def cids_unique_check(assignment: DataFrame) -> DataFrame:
    """Cluster ids used by more than one data set."""
    per = assignment.select("cluster_id", "dataset").distinct()
    return per.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_datasets")).where("n_datasets > 1")


def global_series_id(df: DataFrame) -> DataFrame:
    """Dense id over the union, ordered by data set and series id, however sparse the ids are."""
    return numbered(df, [], ["dataset", "series_id"], "rn").withColumn("global_id", F.col("rn") - 1).drop("rn")


def global_cluster_id(assignment: DataFrame) -> DataFrame:
    """Renumber clusters over all data sets by first appearance.

    Clusters are aggregated first; what is numbered is one row per cluster.
    """
    firsts = assignment.groupBy("dataset", "cluster_id").agg(F.min("series_id").alias("first_series"))
    per_ds = numbered(firsts, ["dataset"], ["first_series"], "pos")
    sizes = firsts.groupBy("dataset").agg(F.count(F.lit(1)).alias("cnt"))
    offs = sizes.select("dataset", F.coalesce(F.sum("cnt").over(
        W.orderBy("dataset").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ids = per_ds.join(offs, "dataset").select(
        "dataset", "cluster_id", (F.col("pos") - 1 + F.col("before")).cast("bigint").alias("global_cluster_id"))
    return assignment.join(ids, ["dataset", "cluster_id"])


def explode_large_clusters(assignment: DataFrame, max_series: int = 15) -> DataFrame:
    """Cut clusters above ``max_series`` into near-equal chunks, in id order.

    The first (n mod chunks) chunks hold one series more. The first chunk keeps its cluster's id, chunk c
    gets ``cluster_id + c * (largest id of the data set + 1)``, which no other cluster has.
    """
    top = assignment.groupBy("dataset").agg((F.max("cluster_id") + 1).alias("stride"))
    sizes = assignment.groupBy("dataset", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    pos = ranked(assignment, ["dataset", "cluster_id"], ["series_id"],
                 F.floor(F.col("series_id") / ID_BUCKET).cast("bigint"), "pos")
    x = F.col("pos") - 1
    parts = F.ceil(F.col("n") / max_series)
    each = F.floor(F.col("n") / parts)
    extra = F.col("n") - each * parts
    cut = extra * (each + 1)
    chunk = F.when(x < cut, F.floor(x / (each + 1))).otherwise(extra + F.floor((x - cut) / each))
    return pos.join(sizes, ["dataset", "cluster_id"]).join(top, "dataset").withColumn(
        "cluster_id", F.when(F.col("n") > max_series, F.col("cluster_id") + chunk * F.col("stride"))
        .otherwise(F.col("cluster_id")).cast("bigint")).select("dataset", "series_id", "cluster_id")

"""Test reservation, splits, folds, balancing and augmentation.

"Random" order is the fixed scatter order of the series id, so every engine and every
retry draws the same rows. Ranks inside a label or a data set are computed in buckets
of that order (``ranked``), because one label may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.functions.columns import SERIES, scatter
from gapmend.operators.blocks import prefix_sums, ranked
from gapmend.operators.neighbors import knn_join

TEST_SHARE, VALIDATION_SHARE = 0.35, 0.25
SUBSETS = [2, 7, 12, 20, 50]
MIN_SHARE, MAX_SHARE = 0.05, 0.20


def scatter_rank(df: DataFrame, part: list[str], id_col: str = "series_id", salt: int = 0, name: str = "rn") -> DataFrame:
    key = scatter(id_col, salt)
    return ranked(df, part, [key, F.col(id_col)], key, name)


def reserve_test_one_cluster(assignment: DataFrame) -> DataFrame:
    """The first cluster of every second data set."""
    firsts = assignment.groupBy("dataset").agg(F.min("cluster_id").alias("cluster_id"))
    # one row per data set is numbered
    n = F.row_number().over(W.orderBy("dataset"))
    return firsts.withColumn("n", n).where("n % 2 = 1").drop("n")


def _reserve(ids: DataFrame, id_col: str, share: float) -> DataFrame:
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    out = scatter_rank(ids, [], id_col).join(total)
    return out.where(F.col("rn") <= F.ceil(F.col("total") * F.lit(share))).drop("rn", "total")


def reserve_test_clusters(assignment: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    return _reserve(assignment.select("dataset", "cluster_id").distinct(), "cluster_id", share)


def reserve_test_series(df: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    return _reserve(df.select(*SERIES).distinct(), "series_id", share)


def stratified_split(df: DataFrame, share: float, id_col: str = "series_id", salt: int = 0, label: str = "label") -> DataFrame:
    """Add ``split``: round(share * n) rows of every label go to test; labels with a
    single member always go to train."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    out = scatter_rank(df, [label], id_col, salt).join(n, label)
    take = F.when(F.col("n_label") > 1, F.round(F.col("n_label") * F.lit(share))).otherwise(0)
    return out.withColumn("split", F.when(F.col("rn") <= take, "test").otherwise("train")).drop("rn", "n_label")


def split_clusters_stratified(df: DataFrame, share: float = VALIDATION_SHARE, salt: int = 0) -> DataFrame:
    """Split clusters by the label of their first series and give series the split."""
    heads = df.groupBy("cluster_id").agg(F.min_by("label", "series_id").alias("label"))
    split = stratified_split(heads, share, "cluster_id", salt).select("cluster_id", "split")
    return df.join(split, "cluster_id")


def split_weighted_clusters(df: DataFrame, weights: DataFrame, validation: float = VALIDATION_SHARE, salt: int = 0) -> DataFrame:
    """Weighted sampling of clusters without replacement: clusters are taken in order
    of ln(u) / weight (largest first) while the rows taken before stay below
    1 - 1.25 * validation of all rows."""
    sizes = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    u = (scatter("cluster_id", salt) + 1) / F.lit(10008.0)
    keyed = sizes.join(weights, "cluster_id").withColumn("key", F.round(-F.log(u) / F.col("weight"), 9))
    order = ranked(keyed, [], ["key", "cluster_id"], F.floor(F.ln(1 + F.col("key")) * 1000).cast("bigint"))
    run = prefix_sums(order, {"cum": "size"}, [], "rn").join(total)
    before = (F.col("cum") - F.col("size")) / F.col("total")
    return run.select("cluster_id", F.when(before < F.lit(1 - 1.25 * validation), "train").otherwise("test").alias("split"))


def update_split_weights(weights: DataFrame, split: DataFrame, factor: float = 0.5) -> DataFrame:
    """Multiply the weight of used clusters and share the loss among the others."""
    w = weights.join(split, "cluster_id").withColumn("used", F.col("split") == "train")
    cut = F.when(F.col("used"), F.col("weight") * factor).otherwise(F.col("weight"))
    w = w.withColumn("cut", cut)
    s = w.agg(F.sum(F.col("weight") - F.col("cut")).alias("loss"), F.count_if(~F.col("used")).alias("n_free"))
    w = w.join(s)
    return w.select("cluster_id", F.when(F.col("n_free") == 0, F.col("weight")).when(F.col("used"), F.col("cut")).otherwise(
        F.col("weight") + F.col("loss") / F.col("n_free")).alias("weight"))


def cv_splits(df: DataFrame, n: int = 3, share: float = VALIDATION_SHARE) -> DataFrame:
    """n independent stratified train/validation splits, tagged ``split_id``.

    All splits are ranked together, keyed by (split_id, label).
    """
    many = df.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    base = F.pmod(F.col("series_id"), F.lit(10007))
    key = F.pmod(base * F.lit(7919) + 104729 + 31 * F.col("split_id"), F.lit(10007))
    n_label = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    out = ranked(many, ["split_id", "label"], [key, "series_id"], key).join(n_label, "label")
    take = F.when(F.col("n_label") > 1, F.round(F.col("n_label") * F.lit(share))).otherwise(0)
    return out.withColumn("split", F.when(F.col("rn") <= take, "test").otherwise("train")).drop("rn", "n_label")


def stratified_kfold(df: DataFrame, k: int, salt: int = 0) -> DataFrame:
    return scatter_rank(df, ["label"], salt=salt).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def reduce_stratified(df: DataFrame, keep: float) -> DataFrame:
    return stratified_split(df, 1 - keep).where("split = 'train'").drop("split")


def balance_all_same(df: DataFrame, by: str = "label") -> DataFrame:
    """As many rows of every class as the smallest class has."""
    low = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n_min"))
    return scatter_rank(df, [by]).join(low).where("rn <= n_min").drop("rn", "n_min")


def balance_rmv_min_reduce_max(df: DataFrame, by: str = "label", low: float = MIN_SHARE, high: float = MAX_SHARE) -> DataFrame:
    """Drop classes below ``low`` of all rows; cut classes above ``high`` to the size of
    the largest class in between."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    n = n.join(n.agg(F.sum("n").alias("total"))).withColumn("share", F.col("n") / F.col("total"))
    cap = n.where((F.col("share") >= low) & (F.col("share") <= high)).agg(F.max("n").alias("cap"))
    keep = n.where(F.col("share") >= low).join(cap).select(
        by, F.when(F.col("share") > high, F.col("cap")).otherwise(F.col("n")).alias("take"))
    return scatter_rank(df, [by]).join(keep, by).where("rn <= take").drop("rn", "take")


def incremental_subset(df: DataFrame, shares=tuple(SUBSETS)) -> DataFrame:
    """Growing training subsets: (iteration, series). A row of rank r of its label is in
    every iteration with r <= ceil(share * n), so the subsets are nested."""
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    out = scatter_rank(df, ["label"]).join(n, "label")
    its = F.array(*[F.when(F.col("rn") <= F.ceil(F.col("n_label") * s / 100), F.lit(i)) for i, s in enumerate(shares)])
    return out.withColumn("iteration", F.explode(F.array_compact(its))).drop("rn", "n_label")


def smote(df: DataFrame, vec: str = "features") -> DataFrame:
    """Add synthetic rows until every label is as large as the largest.

    Row i of a label starts from its (i mod n)-th member in scatter order and moves to
    one of that member's k nearest of the same label, k = min(smallest class - 1, 5).
    Nothing is added when the smallest class has fewer than two rows.
    """
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    lim = n.agg(F.max("n").alias("n_max"), F.min("n").alias("n_min")).first()
    k = min(lim["n_min"] - 1, 5)
    if k < 1:
        return df.select("series_id", "label", vec, F.lit(False).alias("synthetic"))
    need = n.where(F.col("n") < lim["n_max"]).withColumn("extra", F.lit(lim["n_max"]) - F.col("n"))
    pts = df.join(need.select("label"), "label", "left_semi").select(
        F.col("series_id").alias("id"), F.col(vec).alias("vec"), "label", F.col("label").alias("grp"))
    near = knn_join(pts, pts, k + 1).select("id", F.slice(F.filter("near", lambda x: x["nid"] != F.col("id")), 1, k).alias("near"))
    base = scatter_rank(df.select("series_id", "label", vec), ["label"]).join(need, "label")
    # member r of n makes rows i = r, r + n, r + 2n, ... below extra
    reps = F.floor((F.col("extra") - F.col("rn") + F.col("n")) / F.col("n"))
    rows = base.where(reps > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), reps - 1)))
    rows = rows.withColumn("i", F.col("rn") - 1 + F.col("i") * F.col("n")).join(near.withColumnRenamed("id", "series_id"), "series_id")
    pick = F.col("near")[F.pmod(F.col("i") * 7 + F.col("series_id"), F.lit(k)).cast("int")]["nid"]
    rows = rows.select("series_id", "label", "i", F.col(vec).alias("v"), pick.alias("nid"),
                       (scatter(F.col("i") * 13 + F.col("series_id")) / F.lit(10007.0)).alias("u"))
    other = df.select(F.col("series_id").alias("nid"), F.col(vec).alias("w"))
    new = rows.join(other, "nid").select(
        (-(F.col("series_id") * 1000003 + F.col("i") + 1)).alias("series_id"), "label",
        F.zip_with("v", "w", lambda a, b: a + F.col("u") * (b - a)).alias(vec), F.lit(True).alias("synthetic"))
    return df.select("series_id", "label", vec, F.lit(False).alias("synthetic")).unionByName(new)


def all_data(df: DataFrame) -> DataFrame:
    return df

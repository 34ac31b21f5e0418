"""Baseline recommenders: profile similarity, error extrapolation, performance matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gapmend.functions.columns import SERIES, div
from gapmend.operators.correlate import block_pairs
from gapmend.operators.evaluate import eval_classification
from gapmend.operators.training import scatter_rank
from gapmend.session import cut_lineage

SHARES = [5, 10, 17, 30]


def profile_vectors(features: DataFrame, assignment: DataFrame) -> DataFrame:
    """Mean of every feature over the series of a cluster."""
    return features.join(assignment, SERIES).groupBy("dataset", "cluster_id", "feature").agg(F.avg("value").alias("value"))


def _vector(df: DataFrame, keys: list[str]) -> DataFrame:
    """One array per key, features in name order; missing values become NaN."""
    v = F.coalesce("value", F.lit(float("nan"))).alias("v")
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", v))), lambda x: x["v"]).alias("vec"))


def similarity_recommend(new: DataFrame, profiles: DataFrame, ranking: DataFrame, error: str = "avg_error") -> DataFrame:
    """Techniques for new series by the lowest (cosine distance x normalised error) over
    all known clusters: (dataset, series_id, algorithm, score, rank).

    ``new``: long features; ``profiles``: long cluster profiles; ``ranking``: one row per
    (cluster, algorithm) with the error. An undefined similarity counts as distance 1.
    Blocks of series meet blocks of clusters and return the best score per technique.
    """
    # one row per (cluster, technique), read twice
    ranking = cut_lineage(ranking.select("dataset", "cluster_id", "algorithm", error))
    top = ranking.agg(F.max(error).alias("top"))
    errs = ranking.join(top).groupBy("dataset", "cluster_id").agg(F.map_from_entries(F.collect_list(
        F.struct("algorithm", (F.col(error) / F.col("top")).alias("e")))).alias("errors"))
    # both sides are counted and then blocked, so their rows are kept
    known = cut_lineage(_vector(profiles, ["dataset", "cluster_id"]).join(errs, ["dataset", "cluster_id"]))
    left = cut_lineage(_vector(new, SERIES)).select(F.lit(0).alias("one"), F.xxhash64(*SERIES).alias("bid"), *SERIES, "vec")
    right = known.select(F.lit(0).alias("one"), F.xxhash64("dataset", "cluster_id").alias("bid"), "vec",
                         F.map_keys("errors").alias("names"), F.map_values("errors").alias("errs"))

    def best(key, a, b):
        cols = ["dataset", "series_id", "algorithm", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)
        va, vb = np.stack(a["vec"].to_numpy()).astype(float), np.stack(b["vec"].to_numpy()).astype(float)
        with np.errstate(all="ignore"):
            sim = (va @ vb.T) / (np.linalg.norm(va, axis=1)[:, None] * np.linalg.norm(vb, axis=1)[None, :])
        dist = np.where(np.isnan(sim), 1.0, 1.0 - sim)
        table = {}
        for j, (names, errs) in enumerate(zip(b["names"], b["errs"])):
            for n, e in zip(names, errs):
                s = dist[:, j] * e
                table[n] = np.minimum(table[n], s) if n in table else s
        parts = [pd.DataFrame({"dataset": a["dataset"], "series_id": a["series_id"], "algorithm": n, "score": s}) for n, s in table.items()]
        return pd.concat(parts)[cols]

    found = block_pairs(left, right, ["one"], best, "dataset string, series_id bigint, algorithm string, score double")
    out = found.groupBy(*SERIES, "algorithm").agg(F.min("score").alias("score"))
    w = W.partitionBy(*SERIES).orderBy(F.round("score", 9), "algorithm")
    return out.withColumn("rank", F.row_number().over(w))


def subset_errors(errors: DataFrame, shares=tuple(SHARES)) -> DataFrame:
    """Mean error per (dataset, algorithm) on growing shares of the series of a data set.

    ``errors``: (dataset, series_id, algorithm, error). The first floor(share * n) series
    in scatter order are used, at least one; 100 stands for all.
    """
    ids = scatter_rank(errors.select(*SERIES).distinct(), ["dataset"])
    n = ids.groupBy("dataset").agg(F.max("rn").alias("n"))
    cuts = F.array(*[F.when(F.col("rn") <= F.greatest(F.floor(F.col("n") * s / 100), F.lit(1)), s) for s in (*shares, 100)])
    use = ids.join(n, "dataset").select(*SERIES, F.explode(F.array_compact(cuts)).alias("pct"))
    return errors.join(use, SERIES).groupBy("dataset", "algorithm", "pct").agg(F.avg("error").alias("error"))


def tdaub_curve(subsets: DataFrame, keep_highest: bool = False) -> DataFrame:
    """Regress the error on the share of data and extrapolate to 100 %.

    Rank 1 is the lowest expected error (the highest with ``keep_highest``).
    """
    part = subsets.where(F.col("pct") < 100)
    x, y = F.col("pct").cast("double"), F.col("error")
    s = part.groupBy("dataset", "algorithm").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                                                 F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    slope = div(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    out = s.withColumn("slope", slope).withColumn("expected", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n") + 100 * F.col("slope"))
    order = F.round("expected", 9)
    w = W.partitionBy("dataset").orderBy(order.desc() if keep_highest else order, "algorithm")
    return out.select("dataset", "algorithm", "expected", F.row_number().over(w).alias("rank"))


def tdaub_eval(subsets: DataFrame) -> DataFrame:
    """How well the expected ranking finds the truly best technique of each data set."""
    subsets = cut_lineage(subsets)
    expected = tdaub_curve(subsets)
    full = subsets.where("pct = 100")
    best = full.groupBy("dataset").agg(F.min(F.struct(F.round("error", 9).alias("e"), "algorithm"))["algorithm"].alias("true_label"))
    first = expected.where("rank = 1").select("dataset", F.col("algorithm").alias("predicted"))
    at = expected.join(best, "dataset").where("algorithm = true_label").select("dataset", "true_label", "rank").join(first, "dataset")
    hit = (F.col("rank") <= 3).cast("double")
    ranks = at.agg(F.avg(hit / 3).alias("precision_at_3"), F.avg(hit).alias("recall_at_3"), F.avg(1 / F.col("rank")).alias("mrr"))
    return eval_classification(at.select(F.lit("").alias("category"), "true_label", "predicted")).join(ranks)


def dataset_size_filter(profile: DataFrame, share: int = SHARES[0], least_series: int = 5, least_steps: int | None = None) -> DataFrame:
    """Data sets that keep enough series (or steps) at the smallest share."""
    if least_steps is not None:
        return profile.where(F.floor(F.col("length") * share / 100) >= least_steps)
    return profile.where(F.floor(F.col("n_series") * share / 100) >= least_series)


def performance_matrix(ranking: DataFrame, assignment: DataFrame, features: DataFrame, techniques: list[str]) -> DataFrame:
    """Average rank of every technique per series (the number of techniques where one is
    missing), for series whose features are all finite."""
    wide = ranking.groupBy("dataset", "cluster_id").agg(*[
        F.coalesce(F.max(F.when(F.col("algorithm") == t, F.col("avg_rank"))), F.lit(float(len(techniques)))).alias(t) for t in techniques])
    v = F.col("value")
    bad = features.where(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))).select(*SERIES).distinct()
    return assignment.join(bad, SERIES, "left_anti").join(wide, ["dataset", "cluster_id"])

"""Errors, rankings and labels from the imputation benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.operators.impute import CLUSTER, SHARES

# The four rankings of the vote: how many shares, from the smallest, each one uses.
VOTES = (1, 4, 6, 8)


def bench_errors(imputed: DataFrame) -> DataFrame:
    """MAE, MSE and RMSE on the hidden cells, per cluster, algorithm and share."""
    e = F.col("imputed") - F.col("value")
    out = imputed.where("hidden").groupBy(*CLUSTER, "algorithm", "miss_perc").agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    return out.withColumn("rmse", F.sqrt("mse"))


def aggregate_bench(bench: DataFrame, indices: list[int], how: str = "mean") -> DataFrame:
    """Aggregate the errors over the shares at ``indices``."""
    agg = {"mean": F.avg, "median": lambda c: F.expr(f"percentile({c}, 0.5)"), "sum": F.sum, "min": F.min, "max": F.max}[how]
    wanted = [SHARES[i] for i in indices]
    return bench.where(F.col("miss_perc").isin(wanted)).groupBy(*CLUSTER, "algorithm").agg(
        *[agg(c).alias(c) for c in ("mae", "mse", "rmse")])


def _by_error(error: str = "error") -> list[Column]:
    # errors are compared at nine digits, so that summation order cannot decide a tie
    return [F.round(error, 9), F.col("algorithm")]


def rank_simple(bench: DataFrame, indices=tuple(range(8)), how: str = "mean", error: str = "rmse") -> DataFrame:
    agg = aggregate_bench(bench, list(indices), how).select(*CLUSTER, "algorithm", F.col(error).alias("error"))
    return agg.withColumn("rank", F.row_number().over(W.partitionBy(*CLUSTER).orderBy(*_by_error())))


def rank_voting(bench: DataFrame, error: str = "rmse") -> DataFrame:
    """Sum of the positions in four rankings; ties go to the better first ranking.

    The four aggregates come from one pass: each error row is copied to the rankings
    that use its share and averaged per (cluster, algorithm, ranking).
    """
    votes = F.array(*[F.when(F.col("miss_perc") <= SHARES[n - 1], i) for i, n in enumerate(VOTES)])
    rows = bench.select(*CLUSTER, "algorithm", F.col(error).alias("e"), F.explode(F.array_compact(votes)).alias("vote"))
    agg = rows.groupBy(*CLUSTER, "algorithm", "vote").agg(F.avg("e").alias("error"))
    pos = agg.withColumn("pos", F.row_number().over(W.partitionBy(*CLUSTER, "vote").orderBy(*_by_error())))
    out = pos.groupBy(*CLUSTER, "algorithm").agg(
        F.sum("pos").alias("votes"), F.min_by("pos", "vote").alias("first_pos"), F.avg("pos").alias("avg_rank"),
        F.avg("error").alias("avg_error"), (F.sum(F.col("error") * F.col("pos")) / F.sum("pos")).alias("weighted_error"),
        F.transform(F.array_sort(F.collect_list(F.struct("vote", "pos"))), lambda x: x["pos"]).alias("ranks"))
    w = W.partitionBy(*CLUSTER).orderBy("votes", "first_pos", "algorithm")
    return out.withColumn("rank", F.row_number().over(w)).drop("votes", "first_pos")


def exclude_algorithms(ranking: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop algorithms and close the ranks."""
    left = ranking.join(excluded.select("algorithm").distinct(), "algorithm", "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy(*CLUSTER).orderBy("rank")))


def collapse_variants(ranking: DataFrame) -> DataFrame:
    """``name_k2``/``name_k3`` become ``name``, keeping the better of them."""
    base = ranking.withColumn("algorithm", F.regexp_replace("algorithm", r"_k\d+$", ""))
    best = base.withColumn("n", F.row_number().over(W.partitionBy(*CLUSTER, "algorithm").orderBy("rank"))).where("n = 1").drop("n")
    return best.withColumn("rank", F.row_number().over(W.partitionBy(*CLUSTER).orderBy("rank")))


def label_mono(ranking: DataFrame) -> DataFrame:
    return ranking.where("rank = 1").select(*CLUSTER, F.col("algorithm").alias("label"))


def label_multi(ranking: DataFrame, algorithms: list[str], top: int = 3) -> DataFrame:
    """0/1 vector over ``algorithms`` with the ``top`` ranked ones set."""
    best = ranking.where(F.col("rank") <= top).groupBy(*CLUSTER).agg(F.collect_set("algorithm").alias("best"))
    return best.select(*CLUSTER, F.array(*[
        F.array_contains("best", a).cast("double") for a in algorithms]).alias("label"))


def score_matrix(bench: DataFrame, algorithms: list[str], error: str = "rmse") -> DataFrame:
    """One row per cluster, one column per algorithm (variants collapsed to the lower error)."""
    agg = aggregate_bench(bench, list(range(8))).withColumn("algorithm", F.regexp_replace("algorithm", r"_k\d+$", ""))
    low = agg.groupBy(*CLUSTER, "algorithm").agg(F.min(error).alias("error"))
    return low.groupBy(*CLUSTER).pivot("algorithm", algorithms).agg(F.first("error"))


def ranking_matrix(ranking: DataFrame, n_ranks: int) -> DataFrame:
    """How many clusters rank each algorithm at each position (r1, r2, ...)."""
    return ranking.groupBy("algorithm").agg(*[
        F.count_if(F.col("rank") == i).alias(f"r{i}") for i in range(1, n_ranks + 1)])


def rare_algorithms(ranking: DataFrame, threshold: float, top: int = 1) -> DataFrame:
    """Algorithms in the ``top`` positions of less than ``threshold`` of the clusters."""
    per = ranking.groupBy("algorithm").agg(F.count_if(F.col("rank") <= top).alias("wins"))
    n = ranking.agg(F.count_if(F.col("rank") == 1).alias("n_clusters"))
    return per.join(n).select("algorithm", "wins", (F.col("wins") / F.col("n_clusters")).alias("share")).where(
        F.col("share") < threshold)


def best_algorithm(bench: DataFrame, error: str = "rmse", excluded: list[str] = ()) -> DataFrame:
    """The algorithm with the lowest mean error of each cluster, and that error."""
    agg = aggregate_bench(bench, list(range(8))).where(~F.col("algorithm").isin(list(excluded)))
    best = agg.groupBy(*CLUSTER).agg(F.min(F.struct(
        F.round(error, 9).alias("e"), "algorithm", F.col(error).alias("error"))).alias("b"))
    return best.select(*CLUSTER, F.regexp_replace("b.algorithm", r"_k\d+$", "").alias("algorithm"),
                       F.col("b.error").alias("error"))

"""Predictions, rankings and metrics.

Predictions are long: (series_id, category, true_label, class, probability), with the column
``dataset`` where series of several data sets share ids; it is part of a row's key then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.functions.columns import div

ALL = "(all)"
ROW = ["series_id", "category", "true_label"]


def row_key(df: DataFrame) -> list[str]:
    """The columns that tell one predicted series from another."""
    return ["dataset", *ROW] if "dataset" in df.columns else ROW


def soft_vote(predictions: list[DataFrame]) -> DataFrame:
    """Average the class probabilities of several models."""
    rows = reduce(DataFrame.unionByName, predictions)
    return rows.groupBy(*row_key(rows), "class").agg(F.avg("probability").alias("probability"))


def decision_to_proba(df: DataFrame, value: str = "decision") -> DataFrame:
    """Rescale decision values to [0, 1] by their global minimum and maximum."""
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(lim).withColumn("probability", div(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")


def predict_label(pred: DataFrame) -> DataFrame:
    """The most probable class; the first class wins a tie. No window is needed."""
    best = F.struct((-F.col("probability")).alias("o"), F.col("class").alias("c"))
    return pred.groupBy(*row_key(pred)).agg(F.min(best)["c"].alias("predicted"))


def rank_recommendations(pred: DataFrame) -> DataFrame:
    """Classes of each series by probability; the last class comes first in a tie."""
    w = W.partitionBy(*row_key(pred)[:-2]).orderBy(F.desc("probability"), F.desc("class"))
    return pred.withColumn("rank", F.row_number().over(w))


def true_rank(pred: DataFrame) -> DataFrame:
    """Rank of the true label per series, NULL (infinite) when no class matches."""
    p = F.col("probability")
    mine = F.max(F.when(F.col("class") == F.col("true_label"), p))
    key = row_key(pred)
    base = pred.groupBy(*key).agg(mine.alias("pt"), F.collect_list(F.struct(p.alias("p"), F.col("class").alias("c"))).alias("all"))
    ahead = F.size(F.filter("all", lambda x: (x["p"] > F.col("pt")) | ((x["p"] == F.col("pt")) & (x["c"] > F.col("true_label")))))
    return base.select(*key, F.when(F.col("pt").isNotNull(), ahead + 1).alias("rank"))


def with_total(df: DataFrame, keys: list[str]) -> list:
    """Grouping sets: (category, keys) and (keys)."""
    return [["category", *keys], [*keys]]


def confusion_matrix(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("true_label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.agg(F.sum("n").alias("total"))).select("true_label", "predicted", "n", (F.col("n") / F.col("total")).alias("share"))


def confusion_multilabel(df: DataFrame, classes: list[str]) -> DataFrame:
    """One 2 x 2 table per class from 0/1 vectors ``truth`` and ``guess``."""
    rows = df.select(F.posexplode(F.zip_with("truth", "guess", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "v"))
    out = rows.groupBy("i").agg(
        F.count_if((F.col("v.a") == 0) & (F.col("v.b") == 0)).alias("tn"), F.count_if((F.col("v.a") == 0) & (F.col("v.b") == 1)).alias("fp"),
        F.count_if((F.col("v.a") == 1) & (F.col("v.b") == 0)).alias("fn"), F.count_if((F.col("v.a") == 1) & (F.col("v.b") == 1)).alias("tp"))
    return out.select(F.array(*[F.lit(c) for c in classes])[F.col("i")].alias("class"), "tn", "fp", "fn", "tp")


def _class_scores(labels: DataFrame) -> DataFrame:
    """Weighted precision, recall, F1 and accuracy per category and over all.

    Rows are reduced to confusion counts first; everything after is tiny.
    """
    conf = labels.groupingSets(with_total(labels, ["true_label", "predicted"]), "category", "true_label", "predicted").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("category").alias("g"))
    conf = conf.withColumn("category", F.when(F.col("g") == 1, ALL).otherwise(F.col("category")))
    hit = F.when(F.col("true_label") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = conf.select("category", F.explode(F.array(
        F.struct(F.col("true_label").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pre"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pre"), F.lit(0).cast("bigint").alias("tp")))).alias("r"))
    per = rows.select("category", "r.*").groupBy("category", "c").agg(F.sum("sup").alias("sup"), F.sum("pre").alias("pre"), F.sum("tp").alias("tp"))
    p = F.coalesce(div("tp", "pre"), F.lit(0.0))
    r = F.coalesce(div("tp", "sup"), F.lit(0.0))
    f = F.coalesce(div(2 * p * r, p + r), F.lit(0.0))
    w = lambda x: F.sum(x * F.col("sup")) / F.sum("sup")
    return per.groupBy("category").agg(
        F.sum("sup").alias("n"), (F.sum("tp") / F.sum("sup")).alias("accuracy"), w(f).alias("f1"), w(p).alias("precision"), w(r).alias("recall"))


def eval_classification(labels: DataFrame) -> DataFrame:
    return _class_scores(labels).where(F.col("category") == ALL).drop("category")


def _rank_aggs(rank: str = "rank", k: int = 3) -> list[Column]:
    hit = F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double")
    return [F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))).alias("mrr"), (F.avg(hit) / k).alias("precision_at_3"), F.avg(hit).alias("recall_at_3")]


def eval_ranking(ranks: DataFrame) -> DataFrame:
    return ranks.agg(*_rank_aggs())


def eval_by_category(pred: DataFrame) -> DataFrame:
    """All metrics per category and over all series."""
    ranks = true_rank(pred)
    r = ranks.groupingSets([["category"], []], "category").agg(*_rank_aggs(), F.grouping("category").alias("g"))
    r = r.withColumn("category", F.when(F.col("g") == 1, ALL).otherwise(F.col("category"))).drop("g")
    return _class_scores(predict_label(pred)).join(r, "category")


def eval_multilabel(df: DataFrame) -> DataFrame:
    """Sample-averaged precision, recall, F1 and exact-match share of 0/1 vectors."""
    both = F.aggregate(F.zip_with("truth", "guess", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    d = df.select(both.alias("tp"), size("truth").alias("t"), size("guess").alias("g"), (F.col("truth") == F.col("guess")).alias("same"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return d.agg(F.avg(z(div("tp", "g"))).alias("precision"), F.avg(z(div("tp", "t"))).alias("recall"),
                 F.avg(z(div(2 * F.col("tp"), F.col("t") + F.col("g")))).alias("f1"), F.avg(F.col("same").cast("double")).alias("accuracy"))


def hamming_loss(labels: DataFrame) -> DataFrame:
    return labels.agg(F.avg((F.col("true_label") != F.col("predicted")).cast("double")).alias("hamming_loss"))


def predictable_only(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Keep rows whose true label some prediction uses."""
    return df.join(classes.select(F.col("predicted").alias("true_label")).distinct(), "true_label", "left_semi")


def results_summary(scores: DataFrame) -> DataFrame:
    """Mean, extremes and best split per model; scores: (model, split_id, f1, r3, runtime)."""
    return scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg("f1").alias("mean_f1"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"),
        F.avg("r3").alias("mean_r3"), F.avg("runtime").alias("mean_runtime"),
        F.max(F.struct(F.round("f1", 9).alias("o"), (-F.col("split_id")).alias("s")))["s"].alias("neg")).withColumn(
        "best_split", -F.col("neg")).drop("neg")

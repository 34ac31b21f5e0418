"""Scores, significance tests and pruning of the model race.

Fold scores are (pipeline_id, fold, f1, r3, runtime). Pair tests work on one row per
pipeline pair, after the fold scores of each pair are reduced to sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.functions.columns import div, student_two_sided

MARGIN, MIN_FOLDS = 0.15, 5
FIRST_FOLDS, NEXT_FOLDS = 10, 3
WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _score(a, b, c, top: Column) -> Column:
    return (a * F.col("f1") + b * F.col("r3") - c * F.col("runtime") / top + c) / F.nullif(a + b + c, F.lit(0.0))


def selection_score(folds: DataFrame, alpha: float = 0.5, beta: float = 0.5, gamma: float = 0.5) -> DataFrame:
    """Weighted mean of F1, recall@3 and speed; runtime relative to the slowest fold."""
    top = folds.agg(F.max("runtime").alias("top"))
    lit = [F.lit(float(w)) for w in (alpha, beta, gamma)]
    return folds.join(top).withColumn("score", _score(*lit, F.col("top"))).drop("top")


def fold_budget(folds: DataFrame, first_round: bool) -> DataFrame:
    """Folds still owed to each pipeline so that all end with equally many scores."""
    n = folds.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("n_scores"))
    top = n.agg(F.max("n_scores").alias("top"))
    return n.join(top).select("pipeline_id", "n_scores", (F.col("top") + (FIRST_FOLDS if first_round else NEXT_FOLDS) - F.col("n_scores")).alias("budget"))


def early_elimination(folds: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Pipelines with at least five folds whose mean F1 is far below the best one."""
    # twelve digits: the order of a sum must not decide a comparison
    m = folds.groupBy("pipeline_id").agg(F.round(F.avg("f1"), 12).alias("mean_f1"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_FOLDS)
    best = m.agg(F.max("mean_f1").alias("best"))
    return m.join(best).where(F.col("mean_f1") < F.col("best") - margin).select("pipeline_id", "mean_f1")


def _pairs(scores: DataFrame) -> DataFrame:
    a = scores.select(F.col("pipeline_id").alias("a"), "fold", F.col("score").alias("sa"))
    b = scores.select(F.col("pipeline_id").alias("b"), "fold", F.col("score").alias("sb"))
    return a.join(b, "fold").where("a < b")


def paired_ttest(scores: DataFrame) -> DataFrame:
    """Two-sided paired t-test of every pair of pipelines over their common folds.

    NULL when all differences are equal.
    """
    d = F.col("sa") - F.col("sb")
    g = _pairs(scores).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("sd"), F.avg("sa").alias("mean_a"), F.avg("sb").alias("mean_b"))
    g = g.withColumn("t", div("diff", F.col("sd") / F.sqrt("n")))
    dof = (F.col("n") - 1).cast("int")
    return g.withColumn("p", F.when(F.col("t").isNotNull() & (F.col("n") > 1), student_two_sided(F.abs("t"), dof))).drop("sd")


def normal_two_sided(z_abs: Column) -> Column:
    """Two-sided normal p-value (Abramowitz & Stegun 7.1.26, error below 1.5e-7)."""
    x = z_abs / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # fixed values of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def ztest_pair(scores: DataFrame) -> DataFrame:
    """Two-sample z-test of every pair, from per-pipeline means and variances."""
    s = scores.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v"))
    a = s.select(F.col("pipeline_id").alias("a"), F.col("n").alias("na"), F.col("m").alias("mean_a"), F.col("v").alias("va"))
    b = s.select(F.col("pipeline_id").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mean_b"), F.col("v").alias("vb"))
    # one row per pipeline on either side: the contest has a few hundred entrants
    pairs = a.join(b, F.col("a") < F.col("b"))
    z = div(F.col("mean_a") - F.col("mean_b"), F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")))
    return pairs.withColumn("z", z).withColumn("p", normal_two_sided(F.abs("z"))).select("a", "b", "mean_a", "mean_b", "z", "p")


def _losses(tests: DataFrame, p_value: float) -> DataFrame:
    loser = F.when(F.col("mean_a") < F.col("mean_b"), F.col("a")).otherwise(F.col("b"))
    return tests.where(F.col("p") < p_value).select(loser.alias("pipeline_id"))


def prune_worse(tests: DataFrame, n_pipelines: int, factor: float, p_value: float = 0.01, gentle: bool = True) -> DataFrame:
    """Pipelines that lose significantly more than T times; T = n // factor or 0."""
    allowed = int(n_pipelines // factor) if gentle else 0
    n = _losses(tests, p_value).groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("losses"))
    return n.where(F.col("losses") > allowed)


def prune_final(tests: DataFrame, target: int, p_value: float = 0.01) -> DataFrame:
    """From the lowest mean upwards, drop pipelines that lose significantly to any other
    until ``target`` remain. Only better pipelines matter, so the order is a rank."""
    means = tests.select(F.col("a").alias("pipeline_id"), F.col("mean_a").alias("m")).union(tests.select("b", "mean_b")).groupBy(
        "pipeline_id").agg(F.avg("m").alias("mean_score"))
    total = means.agg(F.count(F.lit(1)).alias("total"))
    bad = means.join(_losses(tests, p_value).distinct(), "pipeline_id", "left_semi")
    bad = bad.withColumn("rn", F.row_number().over(W.orderBy(F.round("mean_score", 9), "pipeline_id")))
    return bad.join(total).where(F.col("rn") <= F.col("total") - target).select("pipeline_id", "mean_score")


def prune_schedule(start: DataFrame, target: int = 5, rounds: int = 5) -> DataFrame:
    """How many pipelines may remain at each iteration: n0 // f^i, f = (n0/target)^(1/rounds)."""
    f = F.pow(F.col("n0") / target, F.lit(1.0 / rounds))
    out = start.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return out.withColumn("max_pipelines", F.round(F.floor(F.round(F.col("n0") / F.pow(f, F.col("iteration")), 9))).cast("bigint"))


def score_parameter_sweep(folds: DataFrame) -> DataFrame:
    """Mean score and rank of every pipeline while one weight varies and two stay 0.5.

    Sums per pipeline are taken once; the fifteen settings re-weight three numbers.
    """
    top = folds.agg(F.max("runtime").alias("top"))
    m = folds.join(top).groupBy("pipeline_id").agg(
        F.avg("f1").alias("f1"), F.avg("r3").alias("r3"), F.avg(F.col("runtime") / F.col("top")).alias("runtime"))
    sets = []
    for i, name in enumerate(("alpha", "beta", "gamma")):
        for v in WEIGHTS:
            w = [0.5, 0.5, 0.5]
            w[i] = v
            sets.append(F.struct(F.lit(name).alias("parameter"), F.lit(v).alias("value"), _score(*[F.lit(x) for x in w], F.lit(1.0)).alias("score")))
    out = m.select("pipeline_id", F.explode(F.array(*sets)).alias("s")).select("pipeline_id", "s.*")
    w = W.partitionBy("parameter", "value").orderBy(F.desc(F.round("score", 9)), "pipeline_id")
    return out.withColumn("rank", F.row_number().over(w))

"""The model race, cross-validated training and recommendation."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import IllegalArgumentException
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from gapmend.operators import evaluate as E, models as M, race as R, training as T
from gapmend.session import cut_lineage

PARALLEL = 4
#: What a fit raises when its parameters do not fit the data (a singular matrix is a ValueError).
PARAMETER_ERRORS = (IllegalArgumentException, ValueError)


def score_fold(train: DataFrame, val: DataFrame, spec: M.Spec) -> dict | None:
    """Fit on ``train`` and score on ``val``; None when the parameters do not fit the data."""
    t0 = time.perf_counter()
    try:
        model = M.fit(train, spec)
        took = time.perf_counter() - t0
        pred = model.predict(val).persist()
        try:
            f1 = E.eval_classification(E.predict_label(pred)).first()["f1"]
            r3 = E.eval_ranking(E.true_rank(pred)).first()["recall_at_3"]
        finally:
            pred.unpersist()
        return {"pipeline_id": spec.id, "f1": float(f1), "r3": float(r3), "runtime": took}
    except PARAMETER_ERRORS as e:  # a misconfigured candidate leaves the race; anything else, as a lost executor, ends it
        print(f"candidate {spec.id} ({spec.classifier}) leaves the race: {type(e).__name__}: {str(e)[:200]}")
        return None


def model_race(train: DataFrame, val: DataFrame, grid: DataFrame, n_start: int, target: int, shares=tuple(T.SUBSETS),
               first_folds: int = R.FIRST_FOLDS, next_folds: int = R.NEXT_FOLDS, p_value: float = 0.01, margin: float = R.MARGIN):
    """Race candidates on growing nested subsets; (pipeline_id, fold, f1, r3, runtime, score).

    Each iteration adds relatives of the survivors, gives every pipeline the folds it
    owes, drops early losers and those that lose significantly. Only scores (a few
    numbers per fit) reach the driver; data stay in Spark.
    """
    spark = train.sparkSession
    subsets = T.incremental_subset(train, shares).persist()
    rows = {r["pipeline_id"]: r for r in M.sample_candidates(grid, n_start).collect()}
    alive, scores, used = list(rows), [], set(rows)
    factor = (n_start / target) ** (1 / len(shares))
    labels = F.array(*[F.lit(r["label"]) for r in train.select("label").distinct().orderBy("label").collect()])
    schema = "pipeline_id bigint, fold int, f1 double, r3 double, runtime double"
    try:
        for it in range(len(shares)):
            if it > 0:
                want = max(round(n_start // factor ** it) - len(alive), len(alive) // 10)
                if want > 0 and alive:
                    ids = lambda s: spark.createDataFrame([(i,) for i in s], "pipeline_id bigint")
                    new = M.mutate_candidates(grid, grid.join(ids(alive), "pipeline_id"), ids(used), want, len(alive))
                    fresh = {r["pipeline_id"]: r for r in grid.join(new.select("pipeline_id"), "pipeline_id").collect()}
                    rows |= fresh
                    used |= set(fresh)
                    alive += sorted(fresh)
            done = {p: sum(s["pipeline_id"] == p for s in scores) for p in alive}
            budget = max(done.values()) + (next_folds if it else first_folds)
            part = subsets.where(F.col("iteration") == it).drop("iteration")
            jobs, cached = [], {}
            for p in alive:
                k = budget - done[p]
                deal = (p % 97, max(k, 2))
                if deal not in cached:
                    folded = T.stratified_kfold(part, deal[1], salt=deal[0])
                    # each class starts at its own fold: else the single members of a small share all lie in fold 0, and nothing is left to train on
                    folded = folded.withColumn("fold", F.pmod(F.col("fold") + F.array_position(labels, F.col("label")), F.lit(deal[1])).cast("int"))
                    # a fit reads its rows several times
                    cached[deal] = folded.persist()
                jobs += [(p, done[p] + f, deal, f) for f in range(k)]
            # folds of different pipelines alternate, so that early losers show early
            jobs.sort(key=lambda j: (j[1], j[0]))
            found, failed, lost = {}, set(), set()

            def run(job):
                p, fold, deal, f = job
                if p in failed or p in lost:
                    return None
                return p, fold, score_fold(cached[deal].where(F.col("fold") != f).drop("fold"), val, M.spec_of(rows[p]))

            with ThreadPoolExecutor(PARALLEL) as pool:
                for res in pool.map(run, jobs):
                    if res is None:
                        continue
                    p, fold, s = res
                    if s is None:
                        failed.add(p)
                        continue
                    found.setdefault(p, []).append({**s, "fold": fold})
                    full = {q: sum(x["f1"] for x in v) / len(v) for q, v in found.items() if len(v) >= R.MIN_FOLDS}
                    if p in full and full[p] < max(full.values()) - margin:
                        lost.add(p)
            for folded in cached.values():
                folded.unpersist()
            alive = [p for p in alive if p in found and p not in failed and p not in lost]
            scores += [s for p in alive for s in found[p]]
            table = spark.createDataFrame([[s[c] for c in ("pipeline_id", "fold", "f1", "r3", "runtime")] for s in scores], schema)
            racing = R.selection_score(table.where(F.col("pipeline_id").isin(alive)))
            tests = R.paired_ttest(racing)
            bad = {r["pipeline_id"] for r in R.prune_worse(tests, len(alive), factor, p_value).collect()}
            alive = [p for p in alive if p not in bad]
        if len(alive) > target:
            racing = R.selection_score(table.where(F.col("pipeline_id").isin(alive)))
            out = {r["pipeline_id"] for r in R.prune_final(R.paired_ttest(racing), target, p_value).collect()}
            alive = [p for p in alive if p not in out]
        return [M.spec_of(rows[p]) for p in alive], R.selection_score(table.where(F.col("pipeline_id").isin(alive)))
    finally:
        subsets.unpersist()


def train_cv(df: DataFrame, specs: list[M.Spec], n_splits: int = 3):
    """Fit every model on every split and keep the best by F1.

    Returns (scores DataFrame, best model by name).
    """
    splits = T.cv_splits(df, n_splits).persist()
    jobs = [(s, i) for s in specs for i in range(n_splits)]

    def run(job):
        spec, i = job
        part = splits.where(F.col("split_id") == i).drop("split_id")
        train, val = part.where("split = 'train'").drop("split"), part.where("split = 'test'").drop("split")
        t0 = time.perf_counter()
        model = M.fit(train, spec)
        took = time.perf_counter() - t0
        pred = model.predict(val)
        f1 = E.eval_classification(E.predict_label(pred)).first()["f1"]
        r3 = E.eval_ranking(E.true_rank(pred)).first()["recall_at_3"]
        return (f"{spec.id}-{spec.classifier}", i, float(f1), float(r3), took), model

    try:
        with ThreadPoolExecutor(PARALLEL) as pool:
            done = list(pool.map(run, jobs))
    finally:
        splits.unpersist()
    best = {}
    for row, model in done:
        if row[0] not in best or row[2] > best[row[0]][0]:
            best[row[0]] = (row[2], model)
    scores = df.sparkSession.createDataFrame([r for r, _ in done], "model string, split_id int, f1 double, r3 double, runtime double")
    return scores, {k: m for k, (_, m) in best.items()}


def recommend(models: list[M.Model], new: DataFrame, labels: list[str]) -> DataFrame:
    """Class probabilities of new series, averaged over the models: one column per class."""
    pred = E.soft_vote([m.predict(new) for m in models])
    return pred.groupBy(*E.row_key(pred)[:-2]).pivot("class", labels).agg(F.first("probability"))


def hyperparam_search(df: DataFrame, folds: int = 3) -> DataFrame:
    """Grid search of a multinomial logistic regression by cross-validation."""
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(df)
    data = index.transform(df).select("y", array_to_vector("features").alias("v")).persist()
    est = LogisticRegression(featuresCol="v", labelCol="y", maxIter=20)
    grid = ParamGridBuilder().addGrid(est.regParam, [0.001, 0.01, 0.1]).addGrid(est.elasticNetParam, [0.0, 0.5]).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, numFolds=folds, seed=7, parallelism=PARALLEL,
                        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="f1")).fit(data)
    data.unpersist()
    rows = [(float(g[est.regParam]), float(g[est.elasticNetParam]), float(m)) for g, m in zip(grid, cv.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "reg_param double, elastic_net double, f1 double")


def per_technique_regressor(train: DataFrame, test: DataFrame, techniques: list[str]) -> DataFrame:
    """One regression of the performance on the features per technique, fitted on ``train``; for each row of
    ``test`` the technique with the lowest predicted value is chosen. Both: series_id, features, one
    column per technique."""
    # every regression reads the tables, so they are computed once
    known = cut_lineage(train).withColumn("v", array_to_vector("features"))
    data = cut_lineage(test).withColumn("v", array_to_vector("features"))
    for t in techniques:
        model = LinearRegression(featuresCol="v", labelCol=t, predictionCol=f"p_{t}", regParam=0.01, solver="normal").fit(known)
        data = model.transform(data)
    best = F.least(*[F.struct(F.col(f"p_{t}").alias("o"), F.lit(t).alias("algorithm")) for t in techniques])
    truth = F.least(*[F.struct(F.col(t).alias("o"), F.lit(t).alias("algorithm")) for t in techniques])
    return data.select("series_id", truth["algorithm"].alias("true_label"), best["algorithm"].alias("predicted"), best["o"].alias("score"))

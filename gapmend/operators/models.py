"""Transforms, classifiers and the candidate grid.

Training tables carry ``features`` (array<double>) and ``label``. A fitted model turns
rows into long predictions: (series_id, category, true_label, class, probability).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import Binarizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gapmend.functions.columns import scatter
from gapmend.operators.evaluate import decision_to_proba
from gapmend.operators.neighbors import knn_join, radius_votes

META = ["series_id", "category", "label"]
KNOTS = 101
RIDGE = 1e-6
ARRAYS = "part int, name string, shape array<int>, data array<double>"


# --- transforms: fit on the training table, apply to any ----------------------------

def normalize_rows(df: DataFrame, norm: str) -> DataFrame:
    x = F.col("features")
    size = (F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)) if norm == "l1"
            else F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)))
    out = df.withColumn("norm", F.when(size == 0, 1.0).otherwise(size))
    return out.withColumn("features", F.transform("features", lambda v: v / F.col("norm"))).drop("norm")


def _columns(df: DataFrame, *aggs: Column) -> list:
    """One row of aggregates per feature: as many rows as there are features."""
    return df.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(*aggs).orderBy("i").collect()


def _lits(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass
class Transform:
    """A fitted row transform as data, so that it can be stored; ``apply`` maps a DataFrame with features to another."""
    kind: str
    name: str | None = None
    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind == "normalizer":
            return normalize_rows(df, self.name)
        a = self.arrays
        if self.kind == "maxabs":
            return df.withColumn("features", F.zip_with("features", _lits(a["top"]), lambda v, m: v / m))
        if self.kind == "standard":
            return df.withColumn("features", F.zip_with(F.zip_with("features", _lits(a["mu"]), lambda v, m: v - m), _lits(a["sd"]), lambda v, s: v / s))
        if self.kind == "quantile":
            knots, qs = a["knots"], np.arange(KNOTS) / (KNOTS - 1)
            return _map_features(df, lambda x: np.stack([(np.interp(x[:, j], k, qs) + 1 - np.interp(-x[:, j], -k[::-1], qs)) / 2 for j, k in enumerate(knots)], axis=1))
        if self.kind == "pca":
            mu, axes = a["mu"], a["axes"]
            return _map_features(df, lambda x: (x - mu) @ axes)
        raise ValueError(f"unknown transform {self.kind}")


def _map_features(df: DataFrame, fn) -> DataFrame:
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(features=list(fn(np.stack(pdf["features"].to_numpy()).astype(float))))
    return df.mapInPandas(run, head)


def fit_maxabs(train: DataFrame) -> Transform:
    return Transform("maxabs", arrays={"top": np.array([r["m"] or 1.0 for r in _columns(train, F.max(F.abs("v")).alias("m"))])})


def fit_standard(train: DataFrame) -> Transform:
    rows = _columns(train, F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return Transform("standard", arrays={"mu": np.array([r["m"] for r in rows]), "sd": np.array([r["s"] or 1.0 for r in rows])})


def fit_quantile(train: DataFrame) -> Transform:
    """Map every feature to its empirical distribution function in [0, 1]."""
    qs = [i / (KNOTS - 1) for i in range(KNOTS)]
    rows = _columns(train, F.percentile_approx("v", qs, 10000).alias("q"))
    return Transform("quantile", arrays={"knots": np.array([r["q"] for r in rows], dtype=float)})


def fit_pca(train: DataFrame, k: int | None = None) -> Transform:
    """All principal components of the centred features.

    The covariance comes from added moments; its eigenvectors are found on the driver,
    where it is features x features, and stay stable with fewer rows than features.
    """
    (_, mu, cov), = _class_moments(train.select(F.lit("").alias("label"), "features")).values()
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k or len(mu)]
    # the sign of an axis is free: make its largest entry positive
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Transform("pca", arrays={"mu": mu, "axes": axes * np.where(sign == 0, 1, sign)})


# --- classifiers --------------------------------------------------------------------

@dataclass(frozen=True)
class Spec:
    """One candidate: optional steps and a classifier with its parameters."""
    classifier: str
    params: dict = field(default_factory=dict, hash=False)
    normalizer: str | None = None
    scaler: str | None = None
    reduction: str | None = None
    id: int = 0


def _meta(df: DataFrame) -> DataFrame:
    return df if "category" in df.columns else df.withColumn("category", F.lit(None).cast("string"))


def _all_classes(votes: DataFrame, labels: list[str]) -> DataFrame:
    """(id, m) with m a map label -> weight; one row per class with its share."""
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, v: s + v)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)).alias("w")) for c in labels])
    return votes.withColumn("total", total).select("id", "total", F.explode(rows).alias("r")).select(
        "id", F.col("r.class").alias("class"), (F.col("r.w") / F.col("total")).alias("probability"))


class Model:
    """A fitted candidate as data: its steps and, by classifier, arrays, a table of points or a Spark ML pipeline."""

    def __init__(self, steps: list[Transform], classifier: str, params: dict, labels: list[str], arrays: dict | None = None,
                 points: DataFrame | None = None, pipeline: PipelineModel | None = None):
        self.steps, self.classifier, self.params, self.labels = steps, classifier, params, labels
        self.arrays, self.points, self.pipeline = arrays or {}, points, pipeline

    def prepare(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.apply(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        df = self.prepare(_meta(df))
        if self.points is not None:
            return {"knn": _knn, "radius": _radius}[self.classifier](df, self.points, self.labels, **self.params)
        if self.pipeline is not None:
            return _pipeline_scores(df, self.classifier, self.pipeline, self.labels)
        return _discriminant_scores(df, self.arrays, self.labels)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write everything below ``path``: the description as JSON, arrays and points as Parquet, a pipeline in Spark's own form."""
        text = json.dumps({"classifier": self.classifier, "params": self.params, "labels": self.labels, "points": self.points is not None,
                           "pipeline": self.pipeline is not None, "steps": [[s.kind, s.name] for s in self.steps]}, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        rows = [(i, name, [int(n) for n in a.shape], [float(v) for v in a.ravel()])
                for i, part in enumerate([*[s.arrays for s in self.steps], self.arrays]) for name, a in part.items()]
        spark.createDataFrame(rows, ARRAYS).write.mode("overwrite").parquet(f"{path}/arrays")
        if self.points is not None:
            self.points.write.mode("overwrite").parquet(f"{path}/points")
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """The model that ``save`` wrote; it predicts the same."""
        m = json.loads(spark.read.text(f"{path}/model").first()["value"])
        parts = [{} for _ in range(len(m["steps"]) + 1)]
        # one row per array of a step or a discriminant, as many numbers as the fitted model has
        for r in spark.read.schema(ARRAYS).parquet(f"{path}/arrays").collect():
            parts[r["part"]][r["name"]] = np.array(r["data"]).reshape(r["shape"])
        steps = [Transform(kind, name, a) for (kind, name), a in zip(m["steps"], parts)]
        return Model(steps, m["classifier"], m["params"], m["labels"], parts[-1], spark.read.parquet(f"{path}/points") if m["points"] else None,
                     PipelineModel.load(f"{path}/pipeline") if m["pipeline"] else None)


def _labels(train: DataFrame) -> list[str]:
    return [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]


def _points(df: DataFrame) -> DataFrame:
    return df.select(F.col("series_id").alias("id"), F.col("features").alias("vec"), "label")


def _attach(df: DataFrame, probs: DataFrame) -> DataFrame:
    who = df.select(F.col("series_id").alias("id"), "category", F.col("label").alias("true_label"))
    return who.join(probs, "id").select(F.col("id").alias("series_id"), "category", "true_label", "class", "probability")


def _knn(df: DataFrame, points: DataFrame, labels: list[str], n_neighbors: int = 5, weights: str = "uniform") -> DataFrame:
    near = knn_join(_points(df).drop("label"), points, n_neighbors)
    if weights == "distance":
        # a neighbour at distance 0 outweighs all others
        zero = F.exists("near", lambda x: x["dist"] == 0)
        w = lambda x: F.when(F.col("zero"), (x["dist"] == 0).cast("double")).otherwise(1 / F.nullif(x["dist"], F.lit(0.0)))
        near = near.withColumn("zero", zero)
    else:
        w = lambda x: F.lit(1.0)
    rows = near.select("id", F.explode(F.transform("near", lambda x: F.struct(x["label"].alias("label"), w(x).alias("w")))).alias("r"))
    votes = rows.groupBy("id", "r.label").agg(F.sum("r.w").alias("w")).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("m"))
    return _attach(df, _all_classes(votes, labels))


def _most_common(train: DataFrame) -> str:
    return train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("o"), "label"))["label"].alias("label")).first()["label"]


def _radius(df: DataFrame, points: DataFrame, labels: list[str], common: str, radius: float = 1.0, weights: str = "uniform") -> DataFrame:
    """A row without neighbours gets the ``common`` label."""
    v = radius_votes(_points(df).drop("label"), points, radius)
    v = v.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("votes", "exact", "weight")))).alias("v"),
                            F.sum("exact").alias("n_exact"))
    # map values: votes, or weights unless a neighbour lies at distance 0
    pick = ((lambda k, x: x["votes"].cast("double")) if weights == "uniform" else
            (lambda k, x: F.when(F.col("n_exact") > 0, x["exact"].cast("double")).otherwise(x["weight"])))
    v = v.select("id", F.transform_values("v", pick).alias("m"))
    every = df.select(F.col("series_id").alias("id")).join(v, "id", "left").withColumn(
        "m", F.coalesce("m", F.create_map(F.lit(common), F.lit(1.0))))
    return _attach(df, _all_classes(every, labels))


def _class_moments(train: DataFrame):
    """Count, sum and second moments per class; partials per Arrow batch, then added."""
    def run(batches):
        for pdf in batches:
            for lab, part in pdf.groupby("label"):
                x = np.stack(part["features"].to_numpy()).astype(float)
                yield pd.DataFrame({"label": [lab], "m": [np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])]})
    parts = train.select("label", "features").mapInPandas(run, "label string, m array<double>")
    flat = parts.select("label", F.posexplode("m").alias("p", "v")).groupBy("label", "p").agg(F.sum("v").alias("v"))
    rows = flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("m")).collect()
    out = {}
    for r in rows:
        m = np.array(r["m"])
        d = int(round(((4 * len(m) - 3) ** 0.5 - 1) / 2))
        n, mu = m[0], m[1:d + 1] / m[0]
        out[r["label"]] = (n, mu, m[d + 1:].reshape(d, d) / n - np.outer(mu, mu))
    return out


def _discriminant(train: DataFrame, labels: list[str], quadratic: bool) -> dict[str, np.ndarray]:
    """Centre, inverse covariance and bias of every class."""
    mom = _class_moments(train)
    total = sum(v[0] for v in mom.values())
    pooled = sum(v[0] / total * v[2] for v in mom.values())
    mus, invs, bias = [], [], []
    for c in labels:
        n, mu, cov = mom[c]
        cov = (cov if quadratic else pooled) + RIDGE * np.trace(pooled) / len(mu) * np.eye(len(mu))
        if quadratic:
            # a class smaller than the feature count borrows from the pooled covariance
            cov = cov if n > len(mu) + 1 else 0.5 * cov + 0.5 * pooled
            cov = cov + RIDGE * np.eye(len(mu))
        mus.append(mu)
        invs.append(np.linalg.inv(cov))
        bias.append(-0.5 * np.linalg.slogdet(cov)[1] + np.log(n / total))
    return {"mu": np.array(mus), "inv": np.array(invs), "bias": np.array(bias)}


def _discriminant_scores(df: DataFrame, arrays: dict[str, np.ndarray], labels: list[str]) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy()).astype(float)
                s = np.stack([b - 0.5 * np.einsum("ij,jk,ik->i", x - mu, inv, x - mu) for mu, inv, b in zip(arrays["mu"], arrays["inv"], arrays["bias"])], axis=1)
                e = np.exp(s - s.max(axis=1, keepdims=True))
                yield pdf[META].assign(p=list(e / e.sum(axis=1, keepdims=True)))
    out = df.select(*META, "features").mapInPandas(run, "series_id bigint, category string, label string, p array<double>")
    return _explode_classes(out, "p", labels)


def _explode_classes(df: DataFrame, col: str, labels: list[str]) -> DataFrame:
    name = F.array(*[F.lit(c) for c in labels])[F.col("k")]
    return df.select(*META, F.posexplode(col).alias("k", "probability")).select(
        "series_id", "category", F.col("label").alias("true_label"), name.alias("class"), "probability")


def _estimator(spec: Spec, n_features: int, n_classes: int, n_rows: int):
    p, common = spec.params, {"featuresCol": "v", "labelCol": "y"}
    c = spec.classifier
    if c == "rf":
        return RandomForestClassifier(numTrees=p.get("n_estimators", 10), maxDepth=p.get("max_depth", 5),
                                      minInstancesPerNode=p.get("min_samples_leaf", 1), seed=7, **common)
    if c == "dt":
        return DecisionTreeClassifier(impurity=p.get("criterion", "gini"), maxDepth=p.get("max_depth", 5),
                                      minInstancesPerNode=p.get("min_samples_leaf", 1), seed=7, **common)
    if c == "extra_tree":
        return RandomForestClassifier(numTrees=1, featureSubsetStrategy="sqrt", bootstrap=False, impurity=p.get("criterion", "gini"),
                                      maxDepth=p.get("max_depth", 5), minInstancesPerNode=p.get("min_samples_leaf", 1), seed=7, **common)
    if c == "gbt":
        base = GBTClassifier(maxIter=p.get("iterations", 10), maxDepth=p.get("depth", 4), stepSize=p.get("learning_rate", 0.1), seed=7)
        return OneVsRest(classifier=base, parallelism=8, **common)
    if c == "gaussian_nb":
        return NaiveBayes(modelType="gaussian", **common)
    if c == "bernoulli_nb":
        return NaiveBayes(modelType="bernoulli", smoothing=p.get("alpha", 1.0), **common)
    if c == "logreg":
        return LogisticRegression(family="multinomial", regParam=1.0 / (p.get("C", 1.0) * max(n_rows, 1)), tol=p.get("tol", 1e-4), maxIter=50, **common)
    if c == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, p.get("hidden", 50), n_classes], tol=p.get("tol", 1e-3),
                                              solver=p.get("solver", "l-bfgs"), maxIter=40, seed=7, **common)
    raise ValueError(f"unknown classifier {c}")


def fit(train: DataFrame, spec: Spec) -> Model:
    """Fit the steps of a candidate in order, then its classifier."""
    steps = []
    train = _meta(train)
    for kind, name in (("normalizer", spec.normalizer), ("scaler", spec.scaler), ("reduction", spec.reduction)):
        if name is None:
            continue
        step = Transform("normalizer", name) if kind == "normalizer" else {
            "maxabs": fit_maxabs, "standard": fit_standard, "quantile": fit_quantile, "pca": fit_pca}[name](train)
        steps.append(step)
        train = step.apply(train)
    clf = spec.classifier
    if clf in ("knn", "radius"):
        params = dict(spec.params) if clf == "knn" else {**spec.params, "common": _most_common(train)}
        return Model(steps, clf, params, _labels(train), points=_points(train))
    if clf in ("lda", "qda"):
        labels = _labels(train)
        return Model(steps, clf, {}, labels, arrays=_discriminant(train, labels, clf == "qda"))
    rows = train.select("label", array_to_vector("features").alias("v"))
    stages = []
    if spec.classifier == "bernoulli_nb":
        rows = rows.withColumnRenamed("v", "raw")
        stages.append(Binarizer(threshold=0.0, inputCol="raw", outputCol="v"))
    weigh = spec.classifier == "bernoulli_nb" and not spec.params.get("fit_prior", True)
    if weigh:
        # a uniform prior: every class gets the same total weight
        n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(n, "label").withColumn("weight", 1.0 / F.col("n"))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    labels = index.labels
    shape = train.select(F.size("features").alias("d")).first()["d"]
    est = _estimator(spec, shape, len(labels), train.count() if spec.classifier == "logreg" else 0)
    if weigh:
        est = est.setWeightCol("weight")
    model = Pipeline(stages=[*stages, est]).fit(index.transform(rows))

    return Model(steps, clf, {}, list(labels), pipeline=model)


def _pipeline_scores(df: DataFrame, classifier: str, pipeline: PipelineModel, labels: list[str]) -> DataFrame:
    raw = "raw" if classifier == "bernoulli_nb" else "v"
    out = pipeline.transform(df.select(*META, array_to_vector("features").alias(raw)))
    if classifier == "gbt":
        rows = _explode_classes(out.select(*META, vector_to_array("rawPrediction").alias("p")), "p", labels)
        return decision_to_proba(rows.withColumnRenamed("probability", "decision")).drop("decision")
    return _explode_classes(out.select(*META, vector_to_array("probability").alias("p")), "p", labels)


# --- candidate grid -------------------------------------------------------------------

# fixed values: the parameter ranges of each classifier
GRID = {
    "knn": {"n_neighbors": [1, 3, 5, 10, 15, 25, 50, 100, 200], "weights": ["uniform", "distance"]},
    "gbt": {"depth": [4, 5, 6, 7, 8, 9, 10], "learning_rate": [0.01, 0.02, 0.03, 0.04], "iterations": [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]},
    "rf": {"n_estimators": [10, 50, 200], "max_depth": [5, 8, 15, 20], "min_samples_leaf": [1, 2, 5, 10]},
    "bernoulli_nb": {"alpha": [0.0, 0.25, 0.5, 0.75, 1.0], "fit_prior": [True, False]},
    "dt": {"criterion": ["gini", "entropy"], "max_depth": [5, 8, 15, 20], "min_samples_leaf": [1, 2, 5, 10]},
    "extra_tree": {"criterion": ["gini", "entropy"], "max_depth": [5, 8, 15, 20], "min_samples_leaf": [1, 2, 5, 10]},
    "gaussian_nb": {"var_smoothing": [1e-11, 1e-10, 1e-9, 1e-8, 1e-7, 1e-6]},
    "lda": {"tol": [1e-2, 1e-3, 1e-4, 1e-5]},
    "logreg": {"tol": [1e-2, 1e-3, 1e-4, 1e-5], "C": [0.1, 1, 10, 100]},
    "mlp": {"hidden": [50, 100, 250], "solver": ["l-bfgs", "gd"], "tol": [1e-2, 1e-3, 1e-4, 1e-5]},
    "qda": {"tol": [1e-2, 1e-3, 1e-4, 1e-5]},
    "radius": {"radius": [1.0, 10.0, 50.0, 100.0], "weights": ["uniform", "distance"]},
}
NORMALIZERS, SCALERS, REDUCTIONS = ["none", "l1", "l2"], ["none", "maxabs", "quantile", "standard"], ["none", "pca"]


def _param_texts(name: str) -> list[str]:
    out = [""]
    for key, values in GRID[name].items():
        out = [f"{o};{key}={v}" if o else f"{key}={v}" for o in out for v in values]
    return out


def candidate_grid(train: DataFrame) -> DataFrame:
    """All step and parameter combinations that the training table allows.

    (pipeline_id, normalizer, scaler, reduction, classifier, params). Combinations are
    built by exploding arrays; neighbour counts above the number of rows are left out.
    """
    clf = F.array(*[F.struct(F.lit(c).alias("classifier"), F.lit(p).alias("params")) for c in sorted(GRID) for p in _param_texts(c)])
    base = train.agg(F.count(F.lit(1)).alias("n_train"))
    for name, values in (("normalizer", NORMALIZERS), ("scaler", SCALERS), ("reduction", REDUCTIONS)):
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = base.withColumn("c", F.explode(clf)).select("n_train", "normalizer", "scaler", "reduction", "c.*")
    k = F.expr("try_cast(regexp_extract(params, 'n_neighbors=([0-9]+)', 1) AS INT)")
    out = out.where(k.isNull() | (k <= F.col("n_train"))).drop("n_train")
    # a few thousand rows at most: the grid does not grow with the data
    n = F.row_number().over(W.orderBy("classifier", "params", "normalizer", "scaler", "reduction"))
    return out.withColumn("pipeline_id", (n - 1).cast("bigint"))


def sample_candidates(grid: DataFrame, n: int) -> DataFrame:
    """n candidates, uniform over classifiers first and over their pipelines second."""
    w = W.partitionBy("classifier").orderBy(scatter("pipeline_id"), "pipeline_id")
    return grid.withColumn("turn", F.row_number().over(w)).orderBy("turn", "classifier").limit(n).drop("turn")


def mutate_candidates(grid: DataFrame, survivors: DataFrame, used: DataFrame, n: int, n_survivors: int) -> DataFrame:
    """New candidates: two thirds share the steps and classifier of a survivor, one
    third is sampled from the rest. Used candidates are never drawn again."""
    free = grid.join(used.select("pipeline_id"), "pipeline_id", "left_anti")
    kin_total = 2 * n // 3
    per = kin_total // n_survivors
    steps = ["normalizer", "scaler", "reduction", "classifier"]
    kin = survivors.select(F.col("pipeline_id").alias("parent"), *steps).join(free, steps)
    # a candidate goes to its first parent only
    one = kin.groupBy("pipeline_id").agg(F.min("parent").alias("parent"))
    w = W.partitionBy("parent").orderBy(scatter("pipeline_id"), "pipeline_id")
    one = one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per).select("pipeline_id", F.lit("kin").alias("origin"))
    rest = sample_candidates(free.join(one, "pipeline_id", "left_anti"), n - kin_total)
    return one.unionByName(rest.select("pipeline_id", F.lit("random").alias("origin")))


def spec_of(row) -> Spec:
    """A grid row as a Spec."""
    params = {}
    for part in filter(None, row["params"].split(";")):
        k, v = part.split("=")
        params[k] = v == "True" if v in ("True", "False") else (int(v) if v.isdigit() else _number(v))
    if row["classifier"] in ("lda", "qda", "gaussian_nb"):
        params = {}
    none = lambda v: None if v == "none" else v
    return Spec(row["classifier"], params, none(row["normalizer"]), none(row["scaler"]), none(row["reduction"]), row["pipeline_id"])


def _number(v: str):
    try:
        return float(v)
    except ValueError:
        return v

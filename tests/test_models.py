"""Models, race and stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.operators import evaluate as E, models as M, training as T
from gapmend.plans import racing
from gapmend.sources import files


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"L{i % 3}", [float(v) for v in rng.normal(size=4) * 0.4 + np.eye(3, 4)[i % 3] * 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "series_id bigint, label string, features array<double>")
    s = T.stratified_split(df, 0.35).persist()
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


SPECS = [M.Spec("knn", {"n_neighbors": 5, "weights": "distance"}), M.Spec("radius", {"radius": 1.0}), M.Spec("rf", scaler="maxabs"),
         M.Spec("dt", normalizer="l2"), M.Spec("extra_tree"), M.Spec("gaussian_nb", scaler="standard"), M.Spec("bernoulli_nb", {"fit_prior": False}),
         M.Spec("lda", reduction="pca"), M.Spec("qda"), M.Spec("logreg", scaler="quantile"), M.Spec("mlp", {"hidden": 5}), M.Spec("gbt", {"iterations": 2})]


@pytest.mark.parametrize("spec", SPECS, ids=[s.classifier for s in SPECS])
def test_classifier(blobs, spec):
    train, test = blobs
    pred = M.fit(train, spec).predict(test).persist()
    n = test.count()
    assert pred.count() == 3 * n
    if spec.classifier != "gbt":
        total = pred.groupBy("series_id").agg(F.sum("probability").alias("s")).agg(F.min("s"), F.max("s")).first()
        assert total[0] == pytest.approx(1, abs=1e-6) and total[1] == pytest.approx(1, abs=1e-6)
    floor = 0.5 if spec.classifier == "bernoulli_nb" else 0.85
    assert E.eval_classification(E.predict_label(pred)).first()["accuracy"] >= floor


def test_splits_are_disjoint_and_subsets_nested(blobs):
    train, test = blobs
    assert train.join(test, "series_id").count() == 0 and train.count() + test.count() == 150
    sub = T.incremental_subset(train)
    for i in range(4):
        a, b = (sub.where(F.col("iteration") == j).select("series_id") for j in (i, i + 1))
        assert a.subtract(b).count() == 0


def test_race_and_recommend(spark, blobs):
    train, test = blobs
    grid = M.candidate_grid(train).where(F.col("classifier").isin("gaussian_nb", "lda", "dt") & (F.col("scaler") != "quantile"))
    specs, scores = racing.model_race(train, test, grid, 3, 1, shares=(30, 60), first_folds=2, next_folds=2)
    assert specs and scores.count() >= 4
    assert scores.where("score < 0 OR score > 1").count() == 0
    rec = racing.recommend([M.fit(train, specs[0])], test, ["L0", "L1", "L2"])
    assert rec.columns == ["series_id", "L0", "L1", "L2"] and rec.count() == test.count()


def test_wide_file_with_datetime_column(spark, tmp_path):
    p = tmp_path / "wide.txt"
    p.write_text("2020-01-01 00:00:00 1.5 2\n2020-01-01 01:00:00 nan 3\n")
    rows = {(r["t"], r["series_id"]): r for r in files.read_series_wide(spark, str(p), "w").collect()}
    assert len(rows) == 4 and rows[0, 0]["value"] == 1.5 and rows[1, 0]["value"] is None and rows[1, 1]["value"] == 3.0
    assert str(rows[1, 1]["ts"]) == "2020-01-01 01:00:00"


def test_pca_components_are_uncorrelated(blobs):
    train, _ = blobs
    out = np.array([r["features"] for r in M.fit_pca(train).apply(train).select("features").collect()])
    cov = np.cov(out.T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-9) and np.all(np.diff(np.diag(cov)) <= 1e-9)
    assert np.allclose(out.mean(axis=0), 0, atol=1e-9)


def test_pca_with_fewer_rows_than_features(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"L{i % 2}", [float(v) for v in rng.normal(size=20)]) for i in range(8)]
    df = spark.createDataFrame(rows, "series_id bigint, label string, features array<double>")
    assert M.fit(df, M.Spec("lda", reduction="pca")).predict(df).count() == 16


def test_feature_sweep_splits_once(spark, sf, monkeypatch):
    """The split depends on ids and labels only; seven combinations share it."""
    from gapmend.catalog import load_catalog
    from gapmend.operators import training as T
    calls, plain = [], T.stratified_split
    monkeypatch.setattr(T, "stratified_split", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    rows = load_catalog()[0]["feature_set_sweep"](spark, sf).collect()
    assert len(calls) == 1 and len(rows) == 7 and len({r["n"] for r in rows}) == 1

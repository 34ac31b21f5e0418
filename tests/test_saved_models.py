"""A saved and loaded model predicts what the fitted one does, for every classifier and step."""

import numpy as np
import pytest

from gapmend.operators import models as M
from gapmend.session import scratch_path
from gapmend.sources import stages

SPECS = [M.Spec("knn", {"n_neighbors": 5, "weights": "distance"}, normalizer="l1", scaler="quantile", reduction="pca"), M.Spec("radius", {"radius": 1.0}, scaler="standard"),
         M.Spec("rf", {"n_estimators": 5}, scaler="maxabs"), M.Spec("dt", normalizer="l2"), M.Spec("extra_tree", reduction="pca"), M.Spec("gaussian_nb", scaler="standard"),
         M.Spec("bernoulli_nb", {"fit_prior": False}), M.Spec("lda", scaler="quantile", reduction="pca"), M.Spec("qda", normalizer="l1"), M.Spec("logreg", scaler="quantile"),
         M.Spec("mlp", {"hidden": 5}), M.Spec("gbt", {"iterations": 2})]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [(i, "c", f"L{i % 3}", [float(v) for v in rng.normal(size=4) + np.eye(3, 4)[i % 3] * 2]) for i in range(90)]
    df = spark.createDataFrame(data, "series_id bigint, category string, label string, features array<double>").persist()
    return df.where("series_id < 60"), df.where("series_id >= 60")


def probabilities(model, test):
    return {(r.series_id, r["class"]): r.probability for r in model.predict(test).collect()}


def test_covers_all_classifiers():
    assert {s.classifier for s in SPECS} == set(M.GRID)


def test_run_round_trip(spark, rows):
    train, test = rows
    models = {s.classifier: M.fit(train, s) for s in SPECS}
    root = scratch_path(spark, "run")
    stages.save_run(root, models, train, test, {"features": 4})
    loaded, train2, test2, manifest = stages.load_run(spark, root)
    assert manifest == {"features": 4, "models": sorted(models)} and train2.count() == 60 and set(loaded) == set(models)
    for name, model in models.items():
        want, got = probabilities(model, test), probabilities(loaded[name], test2)
        assert want.keys() == got.keys() and len(want) == 90, name
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want), name
        assert [s.kind for s in loaded[name].steps] == [s.kind for s in model.steps] and loaded[name].labels == model.labels

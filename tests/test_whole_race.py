"""The race queries run the whole grid, on the operator's own shares and folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.catalog import load_catalog, q10_models as Q
from gapmend.operators import models as M
from gapmend.plans import racing

QUERIES, _ = load_catalog()


@pytest.fixture
def asked(monkeypatch):
    """What the queries ask of the operators."""
    got = {}

    def race(train, val, grid, *a, **kw):
        got["grid"], got["whole"], got["race"] = grid, M.candidate_grid(train), (a, kw)
        return [M.Spec("gaussian_nb", id=5), M.Spec("lda", id=6)], train.sparkSession.createDataFrame([(5, 0, 0.5, 0.5)], "pipeline_id long, fold int, f1 double, r3 double")
    monkeypatch.setattr(racing, "model_race", race)
    return got


def test_whole_grid_races(spark, sf, asked):
    assert QUERIES["model_race"](spark, sf).count() == 1
    assert asked["race"] == ((Q.RACE_START, Q.RACE_TARGET), {})
    assert asked["grid"].count() == asked["whole"].count()
    assert {r[0] for r in asked["grid"].select("classifier").distinct().collect()} == set(M.GRID)
    assert M.sample_candidates(asked["grid"], Q.RACE_START).select("classifier").distinct().count() == len(M.GRID)


def test_winners_are_trained_on_three_splits(spark, sf, asked):
    rows = QUERIES["train_cv"](spark, sf).collect()
    assert {(r.model, r.split_id) for r in rows} == {(m, i) for m in ("5-gaussian_nb", "6-lda") for i in range(3)}


def test_only_parameter_errors_leave_the_race(monkeypatch):
    def fails(error):
        def fit(*_):
            raise error
        return fit
    monkeypatch.setattr(M, "fit", fails(np.linalg.LinAlgError("singular")))
    assert racing.score_fold(None, None, M.Spec("lda")) is None
    monkeypatch.setattr(M, "fit", fails(RuntimeError("executor lost")))
    with pytest.raises(RuntimeError):
        racing.score_fold(None, None, M.Spec("lda"))


def test_share_with_one_member_a_class(spark):
    """No fold takes all rows away from the training side."""
    rng = np.random.default_rng(5)
    rows = [(i, f"L{i % 3}", [float(v) for v in rng.normal(size=4) * 0.4 + np.eye(3, 4)[i % 3] * 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "series_id bigint, label string, features array<double>")
    grid = M.candidate_grid(df).where("classifier = 'dt' AND params = 'criterion=gini;max_depth=5;min_samples_leaf=1' AND normalizer = 'none' AND scaler = 'none' AND reduction = 'none'")
    specs, scores = racing.model_race(df.where(F.col("series_id") < 20), df.where(F.col("series_id") >= 20), grid, 1, 1, shares=(5,), first_folds=3)
    assert len(specs) == 1 and scores.count() == 3

"""The same answers when series, groups and cells are cut into very small blocks."""

import check
import pytest

from gapmend.catalog import load_catalog
from gapmend.operators import blocks, correlate, neighbors, series

QUERIES, ORACLE = load_catalog()
NAMES = ["impute_locf", "impute_nocb", "impute_linear", "impute_movavg_k3", "f_strikes", "f_mass_quantile", "f_peaks", "f_autocorr",
         "f_entropy_perm", "f_nonlinear", "k_kpss", "k_simple", "c22_stretch", "c22_fluct", "c22_periodicity", "explode_large_clusters", "global_series_id", "global_cluster_id",
         "stratified_kfold", "split_weighted_clusters", "smote", "clf_knn_distance", "clf_radius_uniform", "mean_ncc", "similarity_recommend"]


@pytest.mark.parametrize("name", NAMES)
def test_small_blocks(name, spark, sf, duck, monkeypatch):
    monkeypatch.setattr(blocks, "STEPS", 50)
    monkeypatch.setattr(blocks, "RANGE_ROWS", 20)
    monkeypatch.setattr(series, "ID_BUCKET", 3)
    monkeypatch.setattr(neighbors, "BUCKET", 20)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 60)
    monkeypatch.setattr(correlate.block_pairs, "__defaults__", (3,))
    msg = check.compare(duck, QUERIES[name](spark, sf), ORACLE[name])
    assert msg in (None, "EMPTY"), msg

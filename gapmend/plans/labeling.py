"""From series and clusters to labelled series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from gapmend.operators import bench as B, impute as I, lowrank as R
from gapmend.operators.series import propagate_cluster_label
from gapmend.session import cut_lineage

#: Imputers that look at the masked series alone, at its cluster, and the low-rank ones.
SINGLE = ("mean", "median", "locf", "nocb", "linear", "movavg_k2", "movavg_k3")
SIBLING = {"regression": I.impute_regression, "knn_series": I.impute_knn_series, "pattern_knn": I.impute_pattern_knn, "als": I.impute_als}
ALL = (*SINGLE, *SIBLING, *R.ALGORITHMS)


def bench_table(cells: DataFrame, steps: int | None = None, algorithms: list[str] | None = None) -> DataFrame:
    """Errors of the single-series imputers on every cluster."""
    masked = I.mask_miss_perc(cells, steps)
    return B.bench_errors(I.impute_simple(masked, algorithms))


def full_bench(cells: DataFrame, steps: int | None = None, algorithms=ALL, context: DataFrame | None = None) -> DataFrame:
    """Errors of ``algorithms``. The first series of each cluster of ``cells`` is masked;
    imputers that use other series see those that ``context`` gives the cluster."""
    context = cells if context is None else context
    masked = I.mask_miss_perc(cells, steps)
    single, low = [a for a in algorithms if a in SINGLE], [a for a in algorithms if a in R.ALGORITHMS]
    runs = [I.impute_simple(masked, single)] if single else []
    runs += [SIBLING[a](masked, context) for a in algorithms if a in SIBLING]
    if low:
        runs.append(R.impute_low_rank_all(masked, context, low))
    return reduce(DataFrame.unionByName, [B.bench_errors(r) for r in runs])


def bench_context(cells: DataFrame, assignment: DataFrame) -> DataFrame:
    """The cells that each cluster's benchmark sees: some of its own series and some
    scattered ones of the data set (``select_bench_series``), at most 15."""
    chosen = I.select_bench_series(assignment).select("dataset", "cluster_id", "series_id")
    return chosen.join(cells.select("dataset", "series_id", "t", "value"), ["dataset", "series_id"])


def selected_bench(cells: DataFrame, assignment: DataFrame, steps: int | None = None, algorithms=ALL) -> DataFrame:
    """``full_bench`` in which imputers that use other series see the selected ones."""
    # every imputer reads both tables
    cells = cut_lineage(cells)
    return full_bench(cells, steps, algorithms, cut_lineage(bench_context(cells, assignment)))


def label_clusters(cells: DataFrame, assignment: DataFrame, steps: int | None = None, algorithms=ALL) -> DataFrame:
    """Mask, impute, score, rank by vote, label and give each series its label.

    All imputers compete, those that use other series on the selected ones.
    """
    if set(algorithms) <= set(SINGLE):
        bench = bench_table(cells, steps, list(algorithms))
    else:
        bench = selected_bench(cells, assignment, steps, algorithms)
    ranking = B.collapse_variants(B.rank_voting(bench))
    return propagate_cluster_label(B.label_mono(ranking), assignment)

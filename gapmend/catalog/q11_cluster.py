"""Clustering."""

from pyspark.sql import functions as F

from gapmend.catalog.base import CM, ES, SM, assignment, clustered_month, embedding_series, query, rounded, supplier_month, table
from gapmend.catalog.q2_series import MC, PAIRS
from gapmend.operators import cluster as C
from gapmend.sources.tables import dataset_profile


def by_region(spark, d):
    """Monthly supplier series with the region as data set (about twenty series each)."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    m = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("region"))
    return supplier_month(spark, d).join(m, "dataset").select(F.col("region").alias("dataset"), "series_id", "t", "value")


def nation_clusters(spark, d):
    """Region as data set, nation as cluster."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    m = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("region"), F.col("n_nationkey").cast("bigint").alias("cluster_id"))
    return supplier_month(spark, d).join(m, "dataset").select(F.col("region").alias("dataset"), "series_id", "cluster_id", "t", "value")


NC = f"""{SM}, cm AS (SELECT r_name AS dataset, series_id, n_nationkey::BIGINT AS cluster_id, t, value FROM sm JOIN nation ON n_name = dataset JOIN region ON r_regionkey = n_regionkey)"""
CEN = """cen AS (SELECT dataset, cluster_id, t, avg(value) v FROM cm GROUP BY 1, 2, 3),
  cz AS (SELECT *, (v - avg(v) OVER p) / nullif(stddev_pop(v) OVER p, 0) z FROM cen WINDOW p AS (PARTITION BY dataset, cluster_id)),
  sim AS (SELECT x.dataset, x.cluster_id AS a, y.cluster_id AS b, avg(x.z * y.z) AS similarity FROM cz x JOIN cz y ON x.dataset = y.dataset AND x.t = y.t AND x.cluster_id < y.cluster_id GROUP BY 1, 2, 3)"""
# the monthly series are close to noise, so the similarity threshold is low
THR = 0.05
UNI = f"""ph AS (SELECT *, sum(n_series) OVER (PARTITION BY dataset) nall FROM mc),
  un AS (SELECT s.dataset, s.a, s.b, similarity, avg(corr) phi FROM sim s JOIN
    (SELECT x.dataset, x.cluster_id ca, y.cluster_id cb, x.series_id i, y.series_id j, avg(x.z * y.z) corr FROM u x JOIN u y ON x.dataset = y.dataset AND x.t = y.t AND x.series_id < y.series_id GROUP BY 1, 2, 3, 4, 5) q
    ON q.dataset = s.dataset AND ca IN (a, b) AND cb IN (a, b) WHERE round(similarity, 9) >= {THR} GROUP BY 1, 2, 3, 4)"""


@query("similar_clusters", f"WITH {NC}, {CEN} SELECT dataset, a, b, round(similarity, 6) AS similarity FROM sim WHERE round(similarity, 9) >= {THR}")
def _(spark, d):
    return rounded(C.similar_clusters(C.cluster_stats(nation_clusters(spark, d)), THR), "similarity").select("dataset", "a", "b", "similarity")


@query("correlation_gain", f"""WITH {NC}, {PAIRS}, {MC}, {CEN}, {UNI} SELECT un.dataset, a, b, round(phi, 6) + 0.0 AS phi_union,
  round((phi - x.mean_corr * y.mean_corr / x.nall) / (2 * x.nall), 6) + 0.0 AS gain FROM un JOIN ph x ON x.dataset = un.dataset AND x.cluster_id = a JOIN ph y ON y.dataset = un.dataset AND y.cluster_id = b
  WHERE x.mean_corr IS NOT NULL AND y.mean_corr IS NOT NULL""")
def _(spark, d):
    return rounded(C.similar_clusters(C.cluster_stats(nation_clusters(spark, d)), THR), "phi_union", "gain").select("dataset", "a", "b", "phi_union", "gain")


@query("far_from_centroid", f"""WITH {NC}, {CEN}, r AS (SELECT cm.dataset, cm.cluster_id, cm.series_id, coalesce(covar_pop(cm.value, v) / nullif(stddev_pop(cm.value) * stddev_pop(v), 0), 0) AS corr
  FROM cm JOIN cen ON cen.dataset = cm.dataset AND cen.cluster_id = cm.cluster_id AND cen.t = cm.t GROUP BY 1, 2, 3)
  SELECT dataset, cluster_id, series_id, round(corr, 6) + 0.0 AS corr FROM r WHERE corr < 0.4 AND cluster_id IN (SELECT cluster_id FROM cm GROUP BY 1 HAVING count(DISTINCT series_id) > 1)""")
def _(spark, d):
    return rounded(C.far_from_centroid(nation_clusters(spark, d)), "corr")


@query("gridsearch_range", f"""WITH {SM}, p AS (SELECT dataset, count(DISTINCT series_id) n, count(DISTINCT series_id) * count(DISTINCT t) c FROM sm GROUP BY 1),
  q AS (SELECT *, greatest(ceil(n / 2 / CASE WHEN c < 50000 THEN 20 WHEN c < 100000 THEN 16 WHEN c < 150000 THEN 13 WHEN c < 200000 THEN 9 ELSE 6 END), 1)::BIGINT st FROM p)
  SELECT dataset, n AS n_series, c AS complexity, range(2, ceil(n / 2 + 1)::BIGINT, st) AS ks FROM q""")
def _(spark, d):
    return C.gridsearch_range(dataset_profile(supplier_month(spark, d)))


@query("nb_runs", f"""WITH {SM} SELECT dataset, (CASE WHEN count(*) <= 50000 THEN 6 WHEN count(DISTINCT t) > 5000 THEN 3 ELSE 4 END)::INTEGER AS runs FROM sm GROUP BY 1""")
def _(spark, d):
    return C.nb_runs(dataset_profile(supplier_month(spark, d)))


@query("kshape")
def _(spark, d):
    arr = C.z_arrays(embedding_series(spark, d)).select("dataset", "series_id", "vals", F.lit(10).cast("bigint").alias("k"), F.lit(0).alias("seed"))
    return C.kshape(arr, ["dataset"], flag=True)


@query("kmeans_series")
def _(spark, d):
    return C.kmeans_series(embedding_series(spark, d), 10)


@query("incremental_cluster")
def _(spark, d):
    return C.incremental_cluster(by_region(spark, d), accept=0.2, accept_all=0.5)


@query("merge_clusters")
def _(spark, d):
    full = nation_clusters(spark, d)
    return C.merge_clusters(full, full.select("dataset", "series_id", "cluster_id").distinct(), THR)


@query("merge_clusters_ratio")
def _(spark, d):
    full = nation_clusters(spark, d)
    return C.merge_clusters_ratio(full, full.select("dataset", "series_id", "cluster_id").distinct(), THR)


@query("merge_small_clusters")
def _(spark, d):
    full = nation_clusters(spark, d)
    return C.merge_small_clusters(full, full.select("dataset", "series_id", "cluster_id").distinct())


@query("apply_constraints")
def _(spark, d):
    full = nation_clusters(spark, d)
    return C.apply_constraints(full, full.select("dataset", "series_id", "cluster_id").distinct())


@query("cluster_gridsearch")
def _(spark, d):
    return rounded(C.cluster_gridsearch(by_region(spark, d)), "score")


@query("best_rerun")
def _(spark, d):
    return C.best_rerun(by_region(spark, d), 3)


@query("cluster_all")
def _(spark, d):
    return C.cluster_all(by_region(spark, d), accept=0.2, accept_all=0.5, threshold=THR)

"""Reshaping, joins and set operations."""

from pyspark.sql import functions as F

from gapmend.catalog.base import (ASG, CM, ES, SM, SM_GAPS, UD, _CELLS, assignment, clustered_month, embedding_series,
                                  nations, query, rounded, supplier_month, table, user_day)
from gapmend.operators import correlate as C, series as S

QUARTERS = [0, 3, 6, 9]


@query("transpose_series", f"""WITH {SM} SELECT dataset, series_id, {", ".join(f"max(CASE WHEN t = {i} THEN value END) AS t{i}" for i in range(0, 83, 6))}
  FROM sm GROUP BY 1, 2""")
def _(spark, d):
    return S.transpose_series(supplier_month(spark, d), list(range(0, 83, 6)))


@query("series_to_array", f"WITH {SM} SELECT dataset, series_id, list(value ORDER BY t) AS vals FROM sm GROUP BY 1, 2")
def _(spark, d):
    return S.series_to_array(supplier_month(spark, d))


Z = """z AS (SELECT *, (value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0) AS zv FROM sm
  WINDOW p AS (PARTITION BY dataset, series_id))"""


@query("znormalize", f"WITH {SM}, {Z} SELECT dataset, series_id, t, round(zv, 6) + 0.0 AS value FROM z")
def _(spark, d):
    return rounded(S.znormalize(supplier_month(spark, d)), "value")


def small_features(spark, d):
    """A few features per user; some are undefined for some users."""
    s = user_day(spark, d)
    return s.groupBy("dataset", "series_id").agg(
        F.count("value").cast("double").alias("known"), F.max("value").alias("top"),
        F.max(F.when(F.col("t") == 3, F.col("value"))).alias("day3"),
        F.max(F.when(F.col("t") == 17, F.col("value"))).alias("day17")).unpivot(
        ["dataset", "series_id"], ["known", "top", "day3", "day17"], "feature", "value")


SF = f"""{UD}, fw AS (SELECT dataset, series_id, count(value)::DOUBLE AS known, max(value) AS top,
    max(CASE WHEN t = 3 THEN value END) AS day3, max(CASE WHEN t = 17 THEN value END) AS day17 FROM ud GROUP BY 1, 2),
feat AS (SELECT dataset, series_id, 'known' AS feature, known AS value FROM fw UNION ALL SELECT dataset, series_id, 'top', top FROM fw
  UNION ALL SELECT dataset, series_id, 'day3', day3 FROM fw UNION ALL SELECT dataset, series_id, 'day17', day17 FROM fw)"""


@query("suffix_features", f"WITH {SF} SELECT dataset, series_id, feature || '_stats' AS feature, round(value, 6) AS value FROM feat")
def _(spark, d):
    return rounded(S.suffix_features(small_features(spark, d), "_stats"), "value")


@query("drop_null_features", f"""WITH {SF} SELECT dataset, series_id, feature, round(value, 6) AS value FROM feat
  WHERE feature IN (SELECT feature FROM feat GROUP BY 1 HAVING count(value) = (SELECT count(*) FROM fw))""")
def _(spark, d):
    return rounded(S.drop_null_features(small_features(spark, d)), "value")


@query("dropped_feature_share", f"""WITH {SF} SELECT 4::BIGINT AS n_features, k AS n_kept, (4 - k) * 10 > 4 AS warn FROM
  (SELECT count(*) AS k FROM (SELECT feature FROM feat GROUP BY 1 HAVING count(value) = (SELECT count(*) FROM fw)))""")
def _(spark, d):
    return S.dropped_share(small_features(spark, d))


@query("nan_to_num", """SELECT event_id, CASE WHEN value > 45 THEN 1.7976931348623157e308 WHEN value < 1 THEN -1.7976931348623157e308
  WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events""")
def _(spark, d):
    inf = float("inf")
    raw = F.when(F.col("value") > 45, inf).when(F.col("value") < 1, -inf).when(
        F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", S.nan_to_num(raw).alias("value"))


@query("align_features", f"""WITH {UD} SELECT dataset, series_id, 0.0::DOUBLE AS median, round(max(value), 6) AS maximum,
  coalesce(round(max(CASE WHEN t = 3 THEN value END), 6), 0.0) AS day3, 0.0::DOUBLE AS slope FROM ud GROUP BY 1, 2""")
def _(spark, d):
    wide = user_day(spark, d).groupBy("dataset", "series_id").agg(
        F.min("value").alias("minimum"), F.max(F.when(F.col("t") == 3, F.col("value"))).alias("day3"), F.max("value").alias("maximum"))
    out = S.align_features(wide, ["median", "maximum", "day3", "slope"])
    return rounded(out, "maximum", "day3")


@query("select_feature_list", f"WITH {SF} SELECT dataset, series_id, feature, round(value, 6) AS value FROM feat WHERE feature IN ('top', 'known')")
def _(spark, d):
    wanted = spark.createDataFrame([("top",), ("known",), ("unused",)], "feature string")
    return rounded(S.select_feature_list(small_features(spark, d), wanted), "value")


@query("join_training_table", f"""WITH {SM}, {ASG},
  lab AS (SELECT dataset, series_id, CASE WHEN sum(value) > 20000 THEN 'big' ELSE 'small' END AS label FROM sm WHERE series_id % 7 <> 3 GROUP BY 1, 2),
  f1 AS (SELECT dataset, series_id, max(value) AS top_stats FROM sm GROUP BY 1, 2),
  f2 AS (SELECT dataset, series_id, count(*) FILTER (WHERE value = 0) AS zeros_counts FROM sm WHERE series_id % 5 <> 2 GROUP BY 1, 2)
  SELECT dataset, series_id, label, top_stats, zeros_counts, cluster_id
  FROM lab FULL JOIN f1 USING (dataset, series_id) FULL JOIN f2 USING (dataset, series_id) FULL JOIN asg USING (dataset, series_id)""")
def _(spark, d):
    sm = supplier_month(spark, d)
    g = sm.groupBy("dataset", "series_id")
    labels = sm.where("series_id % 7 <> 3").groupBy("dataset", "series_id").agg(
        F.when(F.sum("value") > 20000, "big").otherwise("small").alias("label"))
    f1 = g.agg(F.max("value").alias("top_stats"))
    f2 = sm.where("series_id % 5 <> 2").groupBy("dataset", "series_id").agg(F.count_if(F.col("value") == 0).alias("zeros_counts"))
    return S.join_training_table(labels, [f1, f2], assignment(spark, d))


CLAB = """clab AS (SELECT dataset, cluster_id, max(value) AS top FROM cm GROUP BY 1, 2)"""


@query("propagate_cluster_label", f"WITH {CM}, {CLAB} SELECT asg.dataset, series_id, asg.cluster_id, top FROM asg JOIN clab ON asg.dataset = clab.dataset AND asg.cluster_id = clab.cluster_id")
def _(spark, d):
    lab = clustered_month(spark, d).groupBy("dataset", "cluster_id").agg(F.max("value").alias("top"))
    return S.propagate_cluster_label(lab, assignment(spark, d))


@query("cluster_members", f"""WITH {CM}, w AS (SELECT dataset, max(cluster_id) AS cluster_id FROM asg GROUP BY 1)
  SELECT cm.dataset, cm.series_id, cm.cluster_id, t, value FROM cm JOIN w ON cm.dataset = w.dataset AND cm.cluster_id = w.cluster_id""")
def _(spark, d):
    asg = assignment(spark, d)
    last = asg.groupBy("dataset").agg(F.max("cluster_id").alias("cluster_id"))
    return S.cluster_members(supplier_month(spark, d), asg, last)


@query("iter_clusters", f"WITH {_CELLS}, {ASG} SELECT dataset, cluster_id, count(*) AS n_series, min(series_id) AS first_series FROM asg GROUP BY 1, 2")
def _(spark, d):
    return S.iter_clusters(assignment(spark, d))


@query("series_outside_cluster", f"""WITH {_CELLS}, {ASG}, w AS (SELECT dataset, min(cluster_id) AS of_cluster FROM asg GROUP BY 1)
  SELECT asg.dataset, series_id, cluster_id, of_cluster FROM asg JOIN w ON asg.dataset = w.dataset WHERE cluster_id <> of_cluster""")
def _(spark, d):
    asg = assignment(spark, d)
    return S.series_outside_cluster(asg, asg.groupBy("dataset").agg(F.min("cluster_id").alias("cluster_id"))).select(
        "dataset", "series_id", "cluster_id", "of_cluster")


@query("series_outside_cluster_by_value", f"""WITH {UD}, a AS (SELECT dataset, series_id, t, round(value, 6) AS v FROM ud),
  arr AS (SELECT dataset, series_id, list(v ORDER BY t) AS vals FROM a GROUP BY 1, 2),
  once AS (SELECT vals FROM arr GROUP BY vals HAVING count(*) = 1)
  SELECT dataset, series_id, series_id % 3 AS cluster_id, 0::BIGINT AS of_cluster FROM arr WHERE series_id % 3 <> 0 AND vals IN (SELECT vals FROM once)""")
def _(spark, d):
    s = user_day(spark, d)
    arr = S.series_to_array(s.withColumn("value", F.round("value", 6)))
    asg = s.select("dataset", "series_id").distinct().withColumn("cluster_id", F.pmod("series_id", F.lit(3)).cast("bigint"))
    return S.series_outside_cluster(asg, asg.groupBy("dataset").agg(F.min("cluster_id").alias("cluster_id")), arr).select(
        "dataset", "series_id", "cluster_id", "of_cluster")


for level, on, sql_on in (("clusters", "cluster_id % 3 = 0", "cluster_id % 3 = 0"),
                          ("datasets", "length(dataset) > 8", "dataset IN (SELECT dataset FROM asg WHERE length(dataset) > 8)"),
                          ("timeseries", "series_id % 3 = 1", "series_id % 3 = 1")):
    @query(f"test_membership_{level}", f"WITH {_CELLS}, {ASG} SELECT dataset, series_id, cluster_id, {sql_on} AS in_test FROM asg")
    def _(spark, d, level=level, on=on):
        asg = assignment(spark, d)
        return S.test_membership(asg, asg.where(on), level)


@query("known_label_filter", """SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0 AND label IN (SELECT label FROM embeddings WHERE vec_id % 3 <> 0 AND label < 7)""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return S.known_label_filter(e.where("vec_id % 3 = 0"), e.where("vec_id % 3 <> 0 AND label < 7")).select("vec_id", "label")


@query("category_join", f"""WITH {SM} SELECT r_name AS category, count(*) AS cells, sum(value) AS total
  FROM sm JOIN nation ON n_name = dataset JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    meta = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("category"))
    return S.category_join(supplier_month(spark, d), meta).groupBy("category").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


@query("cids_unique_check", f"""WITH {_CELLS}, {ASG} SELECT cluster_id, count(DISTINCT dataset) AS n_datasets
  FROM (SELECT dataset, cluster_id % 10 AS cluster_id FROM asg) GROUP BY 1 HAVING count(DISTINCT dataset) > 1""")
def _(spark, d):
    return S.cids_unique_check(assignment(spark, d).withColumn("cluster_id", F.col("cluster_id") % 10))


@query("global_series_id", f"WITH {_CELLS}, {ASG} SELECT dataset, series_id, row_number() OVER (ORDER BY dataset, series_id) - 1 AS global_id FROM asg")
def _(spark, d):
    return S.global_series_id(assignment(spark, d).select("dataset", "series_id"))


@query("global_cluster_id", f"""WITH {_CELLS}, {ASG}, f AS (SELECT dataset, cluster_id, min(series_id) AS s FROM asg GROUP BY 1, 2),
  g AS (SELECT dataset, cluster_id, row_number() OVER (ORDER BY dataset, s) - 1 AS global_cluster_id FROM f)
  SELECT asg.dataset, series_id, asg.cluster_id, global_cluster_id FROM asg JOIN g ON g.dataset = asg.dataset AND g.cluster_id = asg.cluster_id""")
def _(spark, d):
    return S.global_cluster_id(assignment(spark, d)).select("dataset", "series_id", "cluster_id", "global_cluster_id")


@query("explode_large_clusters", f"WITH {_CELLS}, {ASG} SELECT dataset, series_id, cluster_id FROM asg")
def _(spark, d):
    return assignment(spark, d)


@query("pairwise_series", f"""WITH {_CELLS}, {ASG} SELECT x.dataset, x.cluster_id, x.series_id AS a, y.series_id AS b
  FROM asg x JOIN asg y ON x.dataset = y.dataset AND x.cluster_id = y.cluster_id AND x.series_id < y.series_id""")
def _(spark, d):
    return C.pairwise_series(assignment(spark, d).withColumn("vals", F.lit(None))).select("dataset", "cluster_id", "a", "b")


# --- correlation measures ----------------------------------------------------------

PAIRS = """u AS (SELECT *, (value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0) AS z FROM cm
    WINDOW p AS (PARTITION BY dataset, series_id)),
pc AS (SELECT x.dataset, x.cluster_id, x.series_id AS a, y.series_id AS b, avg(x.z * y.z) AS corr
  FROM u x JOIN u y ON x.dataset = y.dataset AND x.cluster_id = y.cluster_id AND x.t = y.t AND x.series_id < y.series_id GROUP BY 1, 2, 3, 4)"""


@query("pairwise_corr", f"WITH {CM}, {PAIRS} SELECT dataset, cluster_id, a, b, round(corr, 6) + 0.0 AS corr FROM pc")
def _(spark, d):
    return rounded(C.pairwise_corr(clustered_month(spark, d)), "corr")


@query("upper_triangle", f"WITH {CM}, {PAIRS} SELECT dataset, cluster_id, list(round(corr, 6) + 0.0 ORDER BY a, b) AS upper FROM pc GROUP BY 1, 2")
def _(spark, d):
    from gapmend.functions.columns import r6
    p = C.pairwise_corr(clustered_month(spark, d))
    return p.groupBy("dataset", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "corr"))),
                                                              lambda x: r6(x["corr"])).alias("upper"))


MC = """mc AS (SELECT dataset, cluster_id, n_series, CASE WHEN n_series = 1 THEN 1.0 WHEN np = n_series * (n_series - 1) // 2 THEN mc END AS mean_corr
  FROM (SELECT dataset, cluster_id, count(DISTINCT series_id) AS n_series FROM cm GROUP BY 1, 2)
  LEFT JOIN (SELECT dataset, cluster_id, avg(corr) AS mc, count(corr) AS np FROM pc GROUP BY 1, 2) USING (dataset, cluster_id))"""


@query("mean_corr", f"WITH {CM}, {PAIRS}, {MC} SELECT dataset, cluster_id, n_series, round(mean_corr, 6) + 0.0 AS mean_corr FROM mc")
def _(spark, d):
    return rounded(C.mean_corr(clustered_month(spark, d)), "mean_corr")


NCC = """nrm AS (SELECT dataset, series_id, sqrt(sum(value * value)) AS nv FROM cm GROUP BY 1, 2),
  ncc AS (SELECT x.dataset, x.cluster_id, x.series_id AS a, y.series_id AS b, x.t - y.t AS shift,
    coalesce(sum(x.value * y.value) / nullif(max(p.nv) * max(q.nv), 0), 0) AS ncc
  FROM cm x JOIN cm y ON x.dataset = y.dataset AND x.cluster_id = y.cluster_id AND x.series_id < y.series_id
  JOIN nrm p ON p.dataset = x.dataset AND p.series_id = x.series_id JOIN nrm q ON q.dataset = y.dataset AND q.series_id = y.series_id
  GROUP BY 1, 2, 3, 4, 5)"""


@query("ncc_c", f"WITH {CM}, {NCC} SELECT dataset, cluster_id, a, b, shift, round(ncc, 6) + 0.0 AS ncc FROM ncc")
def _(spark, d):
    return rounded(C.ncc_c(clustered_month(spark, d)), "ncc")


MN = """mn AS (SELECT dataset, cluster_id, coalesce(avg(best), 1.0) AS mean_ncc, count(best) AS pairs FROM
  (SELECT DISTINCT dataset, cluster_id FROM cm) LEFT JOIN
  (SELECT dataset, cluster_id, a, b, max(ncc) AS best FROM ncc GROUP BY 1, 2, 3, 4) USING (dataset, cluster_id) GROUP BY 1, 2)"""


@query("mean_ncc", f"WITH {CM}, {NCC}, {MN} SELECT dataset, cluster_id, round(mean_ncc, 6) AS mean_ncc, pairs FROM mn")
def _(spark, d):
    return rounded(C.mean_ncc(clustered_month(spark, d)), "mean_ncc")


@query("clustering_run_score", f"WITH {CM}, {NCC}, {MN} SELECT dataset, round(avg(mean_ncc), 6) AS run_score, count(*) AS n_clusters FROM mn GROUP BY 1")
def _(spark, d):
    return rounded(C.clustering_run_score(clustered_month(spark, d)), "run_score")


@query("centroid", f"WITH {CM} SELECT dataset, cluster_id, t, round(avg(value), 6) AS value FROM cm GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(C.centroid(clustered_month(spark, d)), "value")


@query("corr_summary", f"""WITH {CM}, {PAIRS} SELECT dataset, cluster_id, round(stddev_pop(corr), 6) AS std_corr,
  round(quantile_cont(corr, 0.5), 6) + 0.0 AS median_corr, count(*) AS n_pairs FROM pc WHERE corr IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return rounded(C.corr_summary(clustered_month(spark, d)), "std_corr", "median_corr")


@query("label_counts", "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY 1")
def _(spark, d):
    return rounded(C.label_counts(table(spark, d, "embeddings").select("label")), "share")


FCP = """f AS (SELECT dataset, series_id, u.* FROM (SELECT dataset, series_id,
    unnest([{'feature': 'mean', 'value': avg(value)}, {'feature': 'max', 'value': max(value)}, {'feature': 'zeros', 'value': (count(*) FILTER (WHERE value = 0))::DOUBLE},
      {'feature': 'sd', 'value': stddev_pop(value)}, {'feature': 'range', 'value': max(value) - min(value)}, {'feature': 'sum', 'value': sum(value)},
      {'feature': 'min', 'value': min(value)}]) AS u FROM sm GROUP BY 1, 2)),
  meta AS (SELECT n_name AS dataset, r_name AS category FROM nation JOIN region ON r_regionkey = n_regionkey),
  m AS (SELECT category, feature, avg(value) AS mean_value FROM f JOIN meta USING (dataset) GROUP BY 1, 2),
  s AS (SELECT feature, stddev_samp(mean_value) AS spread FROM m GROUP BY 1 ORDER BY round(spread, 9) DESC, feature LIMIT 5)"""


@query("feature_category_profile", f"WITH {SM}, {FCP} SELECT category, feature, round(mean_value, 6) AS mean_value, round(spread, 6) AS spread FROM m JOIN s USING (feature)")
def _(spark, d):
    sm = supplier_month(spark, d)
    f = sm.groupBy("dataset", "series_id").agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.count_if(F.col("value") == 0).cast("double").alias("zeros"),
        F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("range"), F.sum("value").alias("sum"),
        F.min("value").alias("min"))
    f = f.unpivot(["dataset", "series_id"], ["mean", "max", "zeros", "sd", "range", "sum", "min"], "feature", "value")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    meta = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("category"))
    return rounded(C.feature_category_profile(f, meta), "mean_value", "spread")


@query("clustering_report", f"""WITH {CM}, {PAIRS}, {MC}, {NCC}, {MN} SELECT dataset, round(avg(mean_corr), 6) + 0.0 AS avg_corr, count(*) AS n_clusters,
  count(*) FILTER (WHERE n_series = 1) AS n_singletons, round(avg(mean_ncc), 6) AS run_score FROM mc JOIN mn USING (dataset, cluster_id) GROUP BY 1""")
def _(spark, d):
    return rounded(C.clustering_report(clustered_month(spark, d)), "avg_corr", "run_score")

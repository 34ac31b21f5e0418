"""Baseline recommenders."""

from pyspark.sql import functions as F

from gapmend.catalog.base import CM_GAPS, assignment, clustered_month, query, rounded, supplier_month
from gapmend.catalog.q3_impute import ALGOS, BENCH, COLL, CTX, ERR, FILL, IMP, MK, VOTE, bench
from gapmend.catalog.q8_training import rk
from gapmend.catalog.q9_evaluate import MET, PR, RKC, RKM, TR, centroid_predictions, cls_sql, RND
from gapmend.operators import baselines as X, bench as B, evaluate as E, training as T
from gapmend.operators.features import stats
from gapmend.plans import labeling as L, racing
from gapmend.session import cut_lineage
from gapmend.sources.tables import dataset_profile

FE = """ft AS (SELECT dataset, cluster_id, series_id, unnest([{'feature': 'skewness', 'value': skewness(value)}, {'feature': 'kurtosis', 'value': kurtosis(value)}]) AS u
   FROM (SELECT dataset, cluster_id, series_id, t, coalesce(value, 0.0) AS value FROM cm) GROUP BY 1, 2, 3),
  fl AS (SELECT dataset, cluster_id, series_id, u.feature AS feature, u.value AS value FROM ft)"""
PF = "pf AS (SELECT dataset, cluster_id, feature, avg(value) AS value FROM fl GROUP BY 1, 2, 3)"


def features(spark, d):
    return stats.shape_moments(supplier_month(spark, d))


@query("profile_vectors", f"WITH {CM_GAPS}, {FE}, {PF} SELECT dataset, cluster_id, feature, round(value, 6) + 0.0 AS value FROM pf")
def _(spark, d):
    return rounded(X.profile_vectors(features(spark, d), assignment(spark, d)), "value")


@query("similarity_recommend", f"""WITH {BENCH}, {VOTE}, {FE}, {PF}, mx AS (SELECT max(avg_error) m FROM voting),
  pv AS (SELECT dataset, cluster_id, max(value) FILTER (WHERE feature = 'kurtosis') k, max(value) FILTER (WHERE feature = 'skewness') s FROM pf GROUP BY 1, 2),
  nv AS (SELECT dataset, series_id, max(value) FILTER (WHERE feature = 'kurtosis') k, max(value) FILTER (WHERE feature = 'skewness') s FROM fl GROUP BY 1, 2),
  dv AS (SELECT nv.dataset, nv.series_id, pv.dataset AS pd, pv.cluster_id, coalesce(1 - (nv.k * pv.k + nv.s * pv.s) / nullif(sqrt(nv.k * nv.k + nv.s * nv.s) * sqrt(pv.k * pv.k + pv.s * pv.s), 0), 1.0) AS dist FROM nv JOIN pv ON true),
  sc AS (SELECT dv.dataset, dv.series_id, algorithm, min(dist * avg_error / m) AS score FROM dv JOIN voting v ON v.dataset = pd AND v.cluster_id = dv.cluster_id CROSS JOIN mx GROUP BY 1, 2, 3)
  SELECT dataset, series_id, algorithm, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY dataset, series_id ORDER BY round(score, 9), algorithm)::INTEGER AS rank FROM sc""")
def _(spark, d):
    f = features(spark, d)
    ranking = B.rank_voting(bench(spark, d))
    return rounded(X.similarity_recommend(f, X.profile_vectors(f, assignment(spark, d)), ranking), "score")


def series_errors(spark, d):
    """RMSE of every single-series imputer on every series, over all shares; one data set."""
    one = supplier_month(spark, d, None).withColumn("cluster_id", F.col("series_id"))
    return L.bench_table(one).groupBy("dataset", F.col("cluster_id").alias("series_id"), "algorithm").agg(F.avg("rmse").alias("error")).withColumn(
        "dataset", F.concat(F.lit("g"), F.pmod("series_id", F.lit(4)).cast("string")))


SE = f"""{CM_GAPS.replace('cm AS (SELECT sm.*, asg.cluster_id FROM sm JOIN asg ON sm.dataset = asg.dataset AND sm.series_id = asg.series_id)', 'cm AS (SELECT sm.*, series_id AS cluster_id FROM sm)')},
  {MK}, {CTX}, {IMP}, {ERR}, se AS (SELECT 'g' || (cluster_id % 4) AS dataset, cluster_id AS series_id, algorithm, avg(rmse) AS error FROM bench GROUP BY 1, 2, 3),
  idn AS (SELECT dataset, series_id, {rk('dataset')} rn, count(*) OVER (PARTITION BY dataset) n FROM (SELECT DISTINCT dataset, series_id FROM se)),
  sb AS (SELECT se.dataset, algorithm, pct, avg(error) AS error FROM se JOIN idn ON idn.dataset = se.dataset AND idn.series_id = se.series_id
    JOIN (SELECT unnest([5, 10, 17, 30, 100]) pct) ON rn <= greatest(floor(n * pct / 100), 1) GROUP BY 1, 2, 3),
  ex AS (SELECT dataset, algorithm, regr_intercept(error, pct) + 100 * regr_slope(error, pct) AS expected FROM sb WHERE pct < 100 GROUP BY 1, 2)"""


@query("subset_errors", f"WITH {SE} SELECT dataset, algorithm, pct, round(error, 6) AS error FROM sb")
def _(spark, d):
    return rounded(X.subset_errors(series_errors(spark, d)), "error")


for name, desc, flag in (("tdaub_curve", "", False), ("tdaub_curve_highest", " DESC", True)):
    @query(name, f"WITH {SE} SELECT dataset, algorithm, round(expected, 6) AS expected, row_number() OVER (PARTITION BY dataset ORDER BY round(expected, 9){desc}, algorithm)::INTEGER AS rank FROM ex")
    def _(spark, d, flag=flag):
        return rounded(X.tdaub_curve(X.subset_errors(series_errors(spark, d)), flag), "expected")


@query("tdaub_eval", f"""WITH {SE}, er AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(expected, 9), algorithm) r FROM ex),
  tb AS (SELECT dataset, algorithm AS true_label FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(error, 9), algorithm) r FROM sb WHERE pct = 100) WHERE r = 1),
  hits AS (SELECT tb.dataset, true_label, er.r, e1.algorithm AS predicted FROM tb JOIN er ON er.dataset = tb.dataset AND er.algorithm = true_label JOIN er e1 ON e1.dataset = tb.dataset AND e1.r = 1),
  al AS (SELECT 'x' AS category, true_label, predicted FROM hits)
  SELECT n, {RND}, (SELECT round(avg((r <= 3)::INT) / 3, 6) FROM hits) AS precision_at_3, (SELECT round(avg((r <= 3)::INT), 6) FROM hits) AS recall_at_3, (SELECT round(avg(1 / r), 6) FROM hits) AS mrr FROM {cls_sql('al')}""")
def _(spark, d):
    return rounded(X.tdaub_eval(X.subset_errors(series_errors(spark, d))), *MET, *RKC)


@query("dataset_size_filter", f"""WITH {CM_GAPS} SELECT dataset, n_series, length, n_series * length AS complexity FROM (SELECT dataset, count(DISTINCT series_id) n_series, count(DISTINCT t) length FROM sm GROUP BY 1)
  WHERE floor(n_series * 50 / 100) >= 2""")
def _(spark, d):
    return X.dataset_size_filter(dataset_profile(supplier_month(spark, d, None)), 50, 2)


TECH = sorted(FILL)


@query("performance_matrix", f"""WITH {BENCH}, {VOTE}, {FE}, bad AS (SELECT DISTINCT dataset, series_id FROM fl WHERE value IS NULL OR isnan(value) OR isinf(value)),
  wd AS (SELECT dataset, cluster_id, {", ".join(f"coalesce(max(avg_rank) FILTER (WHERE algorithm = '{t}'), {len(TECH)}.0::DOUBLE) AS {t}" for t in TECH)} FROM voting GROUP BY 1, 2)
  SELECT wd.dataset, wd.cluster_id, series_id, {", ".join(f"round({t}, 6) AS {t}" for t in TECH)} FROM wd JOIN asg ON asg.dataset = wd.dataset AND asg.cluster_id = wd.cluster_id
  WHERE series_id NOT IN (SELECT series_id FROM bad)""")
def _(spark, d):
    m = X.performance_matrix(B.rank_voting(bench(spark, d)), assignment(spark, d), features(spark, d), TECH)
    return rounded(m, *TECH)


@query("per_technique_regressor")
def _(spark, d):
    f = features(spark, d).unionByName(stats.counts(supplier_month(spark, d)))
    m = X.performance_matrix(B.rank_voting(bench(spark, d)), assignment(spark, d), f, TECH)
    vec = X._vector(f, ["dataset", "series_id"]).withColumnRenamed("vec", "features")
    rows = cut_lineage(m.join(vec, ["dataset", "series_id"]))
    held = T.reserve_test_series(rows)
    train, test = (rows.join(held, ["dataset", "series_id"], how) for how in ("left_anti", "left_semi"))
    return rounded(racing.per_technique_regressor(train, test, TECH), "score")


# rules that know only the classes below L8 are judged on the rows they can get right
@query("kiviat_eval", f"""WITH {PR}, kn AS (SELECT * FROM pr WHERE class < 'L8'), {TR.replace('FROM pr)', 'FROM kn)')},
  pu AS (SELECT DISTINCT class FROM rx WHERE rank = 1) SELECT {RKM} FROM tr WHERE true_label IN (SELECT class FROM pu)""")
def _(spark, d):
    p = centroid_predictions(spark, d).where(F.col("class") < "L8")
    first = E.rank_recommendations(p).where("rank = 1").select(F.col("class").alias("predicted"))
    return rounded(E.eval_ranking(E.predictable_only(E.true_rank(p), first)), *RKC)

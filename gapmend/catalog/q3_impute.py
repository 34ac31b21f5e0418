"""Imputation benchmark, rankings and labels."""

from pyspark.sql import functions as F

from gapmend.catalog.base import (ASG, CM, CM_GAPS, MONTHS, _CELLS, assignment, clustered_month, query, rounded)
from gapmend.operators import bench as B, impute as I, lowrank as R
from gapmend.plans import labeling as L

K4 = "dataset, cluster_id, series_id, miss_perc"
MK = f"""fst AS (SELECT dataset, cluster_id, min(series_id) AS series_id FROM cm GROUP BY 1, 2),
mk AS (SELECT *, CASE WHEN NOT hidden THEN value END AS x FROM
  (SELECT cm.dataset, cm.cluster_id, cm.series_id, miss_perc, t, value,
    (t >= 4 AND t < 4 + floor({MONTHS} * miss_perc / 100.0) AND value IS NOT NULL) AS hidden
  FROM cm JOIN fst ON cm.dataset = fst.dataset AND cm.cluster_id = fst.cluster_id AND cm.series_id = fst.series_id
  CROSS JOIN (SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80]) AS miss_perc)))"""
CTX = f"""ctx AS (SELECT *,
  last_value(x IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt,
  first_value(x IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt,
  avg(x) OVER (PARTITION BY {K4} ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ma2,
  avg(x) OVER (PARTITION BY {K4} ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS ma3,
  avg(x) OVER a AS mu, quantile_cont(x, 0.5) OVER a AS med, stddev_pop(x) OVER a AS sd
  FROM mk WINDOW a AS (PARTITION BY {K4}), b AS (PARTITION BY {K4} ORDER BY t ROWS UNBOUNDED PRECEDING),
  f AS (PARTITION BY {K4} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
FILL = {
    "mean": "coalesce(mu, 0.0)", "median": "coalesce(med, 0.0)", "locf": "coalesce(pv, nv, 0.0)", "nocb": "coalesce(nv, pv, 0.0)",
    "linear": "coalesce(CASE WHEN pt < nt THEN pv + (nv - pv) / (nt - pt) * (t - pt) END, pv, nv, 0.0)",
    "movavg_k2": "coalesce(ma2, mu, 0.0)", "movavg_k3": "coalesce(ma3, mu, 0.0)"}


def one(a):
    return f"SELECT {K4}, t, value, hidden, '{a}' AS algorithm, coalesce(x, {FILL[a]}) AS imputed FROM ctx"


def final(src):
    return f"SELECT {K4}, t, value, hidden, algorithm, round(imputed, 6) + 0.0 AS imputed FROM ({src})"


IMP = "imp AS (" + " UNION ALL ".join(one(a) for a in FILL) + ")"
ERR = """bench AS (SELECT *, sqrt(mse) AS rmse FROM (SELECT dataset, cluster_id, algorithm, miss_perc, avg(abs(imputed - value)) AS mae,
  avg((imputed - value) * (imputed - value)) AS mse FROM imp WHERE hidden GROUP BY 1, 2, 3, 4))"""
BENCH = f"{CM_GAPS}, {MK}, {CTX}, {IMP}, {ERR}"


def masked(spark, d):
    return I.mask_miss_perc(clustered_month(spark, d, None))


def bench(spark, d):
    return L.bench_table(clustered_month(spark, d, None))


@query("select_bench_series", f"""WITH {_CELLS}, {ASG}, sz AS (SELECT dataset, cluster_id, count(*) AS size FROM asg GROUP BY 1, 2),
  tot AS (SELECT dataset, count(*) AS total FROM asg GROUP BY 1),
  inn AS (SELECT asg.*, size, total, row_number() OVER (PARTITION BY asg.dataset, asg.cluster_id ORDER BY series_id) AS pos,
    greatest(5 - (least(size, 2) + least(total - size, 10)), 0) AS lack FROM asg JOIN sz ON sz.dataset = asg.dataset AND sz.cluster_id = asg.cluster_id
    JOIN tot ON tot.dataset = asg.dataset),
  rnd AS (SELECT sz.dataset, sz.cluster_id, o.series_id, row_number() OVER (PARTITION BY sz.dataset, sz.cluster_id
     ORDER BY ((o.series_id % 10007) * 7919 + 104729) % 10007, o.series_id) AS rn
    FROM sz JOIN asg o ON o.dataset = sz.dataset AND o.cluster_id <> sz.cluster_id)
  SELECT dataset, cluster_id, series_id, CASE WHEN lack > 0 AND size - 2 < lack THEN 'short' WHEN pos <= 2 THEN 'cluster' ELSE 'tail' END AS role
    FROM inn WHERE (lack > 0 AND size - 2 < lack) OR pos <= 2 OR pos > size - lack
  UNION ALL SELECT dataset, cluster_id, series_id, 'random' FROM rnd WHERE rn <= 10""")
def _(spark, d):
    return I.select_bench_series(assignment(spark, d))


@query("select_bench_series_cluster", f"WITH {_CELLS}, {ASG} SELECT dataset, cluster_id, series_id, 'cluster' AS role FROM asg")
def _(spark, d):
    return I.select_bench_series(assignment(spark, d), "CLUSTER")


@query("select_bench_series_dataset", f"""WITH {_CELLS}, {ASG}, f AS (SELECT dataset, cluster_id, min(series_id) AS s FROM asg GROUP BY 1, 2)
  SELECT dataset, cluster_id, s AS series_id, 'target' AS role FROM f
  UNION ALL SELECT f.dataset, f.cluster_id, a.series_id, 'dataset' FROM f JOIN asg a ON a.dataset = f.dataset""")
def _(spark, d):
    return I.select_bench_series(assignment(spark, d), "DATASET")


@query("mask_miss_perc", f"WITH {CM_GAPS}, {MK} SELECT {K4}, t, value, hidden FROM mk")
def _(spark, d):
    return masked(spark, d)


for algo in FILL:
    @query("impute_" + algo, f"WITH {CM_GAPS}, {MK}, {CTX} " + final(one(algo)))
    def _(spark, d, algo=algo):
        return rounded(I.impute(masked(spark, d), algo), "imputed")


SIB = f"""fit AS (SELECT dataset, cluster_id, series_id, miss_perc, sib, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS r,
    (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sx / n AS smu, sqrt(sxx / n - (sx / n) * (sx / n)) AS ssd, sy / n AS ymu
  FROM (SELECT mk.dataset, mk.cluster_id, mk.series_id, miss_perc, c.series_id AS sib, count(*)::DOUBLE AS n, sum(c.value) AS sx, sum(x) AS sy,
     sum(c.value * c.value) AS sxx, sum(x * x) AS syy, sum(c.value * x) AS sxy
   FROM mk JOIN cm c ON c.dataset = mk.dataset AND c.cluster_id = mk.cluster_id AND c.t = mk.t AND c.series_id <> mk.series_id
   WHERE x IS NOT NULL AND c.value IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
  WHERE n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9),
rk AS (SELECT *, row_number() OVER (PARTITION BY {K4} ORDER BY -round(abs(r), 9), sib) AS rn FROM fit)"""
ON4 = "{0}.dataset = {1}.dataset AND {0}.cluster_id = {1}.cluster_id AND {0}.series_id = {1}.series_id AND {0}.miss_perc = {1}.miss_perc"


REG = f"""SELECT x1.dataset, x1.cluster_id, x1.series_id, x1.miss_perc, x1.t, x1.value, hidden, 'regression' AS algorithm,
  coalesce(x, (ymu - slope * smu) + slope * s.value, mu, 0.0) AS imputed
  FROM ctx x1 LEFT JOIN rk ON {ON4.format('x1', 'rk')} AND rn = 1
  LEFT JOIN cm s ON s.dataset = x1.dataset AND s.cluster_id = x1.cluster_id AND s.series_id = sib AND s.t = x1.t"""
KNN = f"""SELECT x1.dataset, x1.cluster_id, x1.series_id, x1.miss_perc, x1.t, x1.value, hidden, 'knn_series' AS algorithm,
  coalesce(x, mu + sd * num / nullif(den, 0), mu, 0.0) AS imputed
  FROM ctx x1 LEFT JOIN (SELECT rk.dataset, rk.cluster_id, rk.series_id, miss_perc, s.t, sum(r * (s.value - smu) / ssd) AS num, sum(abs(r)) AS den
    FROM rk JOIN cm s ON s.dataset = rk.dataset AND s.cluster_id = rk.cluster_id AND s.series_id = sib WHERE rn <= 3 AND s.value IS NOT NULL GROUP BY 1, 2, 3, 4, 5) z
  ON {ON4.format('x1', 'z')} AND x1.t = z.t"""

@query("impute_regression", f"WITH {CM_GAPS}, {MK}, {CTX}, {SIB} " + final(REG))
def _(spark, d):
    return rounded(I.impute_regression(masked(spark, d), clustered_month(spark, d, None)), "imputed")


@query("impute_knn_series", f"WITH {CM_GAPS}, {MK}, {CTX}, {SIB} " + final(KNN))
def _(spark, d):
    return rounded(I.impute_knn_series(masked(spark, d), clustered_month(spark, d, None)), "imputed")


PATTERN = f"""rf AS (SELECT rk.dataset, rk.cluster_id, rk.series_id, miss_perc, s.t, coalesce(s.value, 0.0) AS y
    FROM rk JOIN cm s ON s.dataset = rk.dataset AND s.cluster_id = rk.cluster_id AND s.series_id = sib WHERE rn = 1),
  w AS (SELECT dataset, cluster_id, series_id, miss_perc, t, y, lag(y, 1) OVER o AS y1, lag(y, 2) OVER o AS y2, lag(y, 3) OVER o AS y3, lag(y, 4) OVER o AS y4
    FROM rf WINDOW o AS (PARTITION BY {K4} ORDER BY t)),
  mw AS (SELECT mk.*, y, y1, y2, y3, y4 FROM mk JOIN w ON {ON4.format('mk', 'w')} AND mk.t = w.t WHERE mk.t >= 4),
  pr AS (SELECT h.dataset, h.cluster_id, h.series_id, h.miss_perc, h.t, g.x AS gx, row_number() OVER (
      PARTITION BY h.dataset, h.cluster_id, h.series_id, h.miss_perc, h.t ORDER BY
      round((h.y-g.y)*(h.y-g.y)+(h.y1-g.y1)*(h.y1-g.y1)+(h.y2-g.y2)*(h.y2-g.y2)+(h.y3-g.y3)*(h.y3-g.y3)+(h.y4-g.y4)*(h.y4-g.y4), 6), g.t) AS rn
    FROM mw h JOIN mw g ON {ON4.format('h', 'g')} WHERE h.x IS NULL AND g.x IS NOT NULL),
  gs AS (SELECT dataset, cluster_id, series_id, miss_perc, t, avg(gx) AS guess FROM pr WHERE rn <= 3 GROUP BY 1, 2, 3, 4, 5),
  pat AS (SELECT x1.dataset, x1.cluster_id, x1.series_id, x1.miss_perc, x1.t, x1.value, hidden, 'pattern_knn' AS algorithm,
    coalesce(x, guess, mu, 0.0) AS imputed FROM ctx x1 LEFT JOIN gs ON {ON4.format('x1', 'gs')} AND x1.t = gs.t)"""


@query("impute_pattern_knn", f"WITH {CM_GAPS}, {MK}, {CTX}, {SIB}, {PATTERN} " + final("SELECT * FROM pat"))
def _(spark, d):
    return rounded(I.impute_pattern_knn(masked(spark, d), clustered_month(spark, d, None)), "imputed")


for algo, name in (("svdimp", "impute_svd"), ("softimp", "impute_softimpute"), ("svt", "impute_svt"),
                   ("cdrec_k2", "impute_cdrec_k2"), ("cdrec_k3", "impute_cdrec_k3")):
    @query(name)
    def _(spark, d, algo=algo):
        return rounded(I.impute_low_rank(masked(spark, d), clustered_month(spark, d, None), algo), "imputed")


@query("low_rank_rounds")
def _(spark, d):
    """How many rounds each low-rank imputer took, and whether it came to rest."""
    fit = R.low_rank_fit(masked(spark, d), clustered_month(spark, d, None))
    return fit.groupBy("dataset", "cluster_id", "series_id", "miss_perc", "algorithm").agg(
        F.count(F.lit(1)).alias("n_sets"), F.max("rounds").alias("rounds"), F.min("converged").alias("converged"))


@query("impute_als")
def _(spark, d):
    return rounded(I.impute_als(masked(spark, d), clustered_month(spark, d, None)), "imputed")


@query("bench_errors", f"""WITH {BENCH} SELECT dataset, cluster_id, algorithm, miss_perc, round(mae, 6) AS mae, round(mse, 6) AS mse,
  round(rmse, 6) AS rmse FROM bench""")
def _(spark, d):
    return rounded(bench(spark, d), "mae", "mse", "rmse")


@query("bench_errors_all")
def _(spark, d):
    return rounded(L.full_bench(clustered_month(spark, d, None)), "mae", "mse", "rmse")


for how, fn in (("mean", "avg"), ("median", "median"), ("sum", "sum"), ("min", "min"), ("max", "max")):
    @query(f"aggregate_bench_{how}", f"""WITH {BENCH} SELECT dataset, cluster_id, algorithm, round({fn}(mae), 6) AS mae, round({fn}(mse), 6) AS mse,
      round({fn}(rmse), 6) AS rmse FROM bench WHERE miss_perc IN (10, 20, 30, 40) GROUP BY 1, 2, 3""")
    def _(spark, d, how=how):
        return rounded(B.aggregate_bench(bench(spark, d), [0, 1, 2, 3], how), "mae", "mse", "rmse")


C2 = "dataset, cluster_id"
SIMPLE = f"""agg AS (SELECT {C2}, algorithm, avg(rmse) AS error FROM bench GROUP BY 1, 2, 3),
  simple AS (SELECT *, row_number() OVER (PARTITION BY {C2} ORDER BY round(error, 9), algorithm)::INTEGER AS rank FROM agg)"""
VOTE = f"""va AS (SELECT {C2}, algorithm, vote, avg(rmse) AS error FROM bench JOIN (SELECT unnest([0, 1, 2, 3]) AS vote, unnest([10, 40, 60, 80]) AS top)
    ON miss_perc <= top GROUP BY 1, 2, 3, 4),
  vp AS (SELECT *, row_number() OVER (PARTITION BY {C2}, vote ORDER BY round(error, 9), algorithm)::INTEGER AS pos FROM va),
  vs AS (SELECT {C2}, algorithm, sum(pos) AS votes, min(CASE WHEN vote = 0 THEN pos END) AS fp, avg(pos) AS avg_rank, avg(error) AS avg_error,
    sum(error * pos) / sum(pos) AS weighted_error, list(pos ORDER BY vote) AS ranks FROM vp GROUP BY 1, 2, 3),
  voting AS (SELECT {C2}, algorithm, avg_rank, avg_error, weighted_error, ranks,
    row_number() OVER (PARTITION BY {C2} ORDER BY votes, fp, algorithm)::INTEGER AS rank FROM vs)"""
COLL = f"""col AS (SELECT {C2}, algorithm, row_number() OVER (PARTITION BY {C2} ORDER BY rank)::INTEGER AS rank FROM
    (SELECT {C2}, regexp_replace(algorithm, '_k[0-9]+$', '') AS algorithm, min(rank) AS rank FROM voting GROUP BY 1, 2, 3))"""
MONO = f"mono AS (SELECT {C2}, algorithm AS label FROM col WHERE rank = 1)"


@query("rank_simple", f"WITH {BENCH}, {SIMPLE} SELECT {C2}, algorithm, round(error, 6) AS error, rank FROM simple")
def _(spark, d):
    return rounded(B.rank_simple(bench(spark, d)), "error")


@query("rank_voting", f"""WITH {BENCH}, {VOTE} SELECT {C2}, algorithm, round(avg_rank, 6) AS avg_rank, round(avg_error, 6) AS avg_error,
  round(weighted_error, 6) AS weighted_error, ranks, rank FROM voting""")
def _(spark, d):
    return rounded(B.rank_voting(bench(spark, d)), "avg_rank", "avg_error", "weighted_error")


@query("exclude_algorithms", f"""WITH {BENCH}, {SIMPLE} SELECT {C2}, algorithm, row_number() OVER (PARTITION BY {C2} ORDER BY rank)::INTEGER AS rank
  FROM simple WHERE algorithm NOT IN ('mean', 'locf')""")
def _(spark, d):
    out = spark.createDataFrame([("mean",), ("locf",)], "algorithm string")
    return B.exclude_algorithms(B.rank_simple(bench(spark, d)), out).select("dataset", "cluster_id", "algorithm", "rank")


@query("collapse_variants", f"WITH {BENCH}, {VOTE}, {COLL} SELECT * FROM col")
def _(spark, d):
    return B.collapse_variants(B.rank_voting(bench(spark, d))).select("dataset", "cluster_id", "algorithm", "rank")


@query("label_mono", f"WITH {BENCH}, {VOTE}, {COLL}, {MONO} SELECT * FROM mono")
def _(spark, d):
    return B.label_mono(B.collapse_variants(B.rank_voting(bench(spark, d))))


ALGOS = ["linear", "locf", "mean", "median", "movavg", "nocb"]


@query("label_multi", f"""WITH {BENCH}, {VOTE}, {COLL} SELECT {C2}, [{", ".join(f"max(CASE WHEN algorithm = '{a}' AND rank <= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE" for a in ALGOS)}] AS label
  FROM col GROUP BY 1, 2""")
def _(spark, d):
    return B.label_multi(B.collapse_variants(B.rank_voting(bench(spark, d))), ALGOS)


@query("score_matrix", f"""WITH {BENCH}, lo AS (SELECT {C2}, regexp_replace(algorithm, '_k[0-9]+$', '') AS a, min(e) AS e FROM
    (SELECT {C2}, algorithm, avg(rmse) AS e FROM bench GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)
  SELECT {C2}, {", ".join(f"round(max(CASE WHEN a = '{a}' THEN e END), 6) AS {a}" for a in ALGOS)} FROM lo GROUP BY 1, 2""")
def _(spark, d):
    return rounded(B.score_matrix(bench(spark, d), ALGOS), *ALGOS)


@query("ranking_matrix", f"""WITH {BENCH}, {SIMPLE} SELECT algorithm, {", ".join(f"count(*) FILTER (WHERE rank = {i}) AS r{i}" for i in range(1, 8))}
  FROM simple GROUP BY 1""")
def _(spark, d):
    return B.ranking_matrix(B.rank_simple(bench(spark, d)), 7)


@query("rare_algorithms", f"""WITH {BENCH}, {SIMPLE} SELECT algorithm, wins, round(share, 6) AS share FROM (SELECT algorithm, count(*) FILTER (WHERE rank = 1) AS wins,
  count(*) FILTER (WHERE rank = 1) / (SELECT count(*) FROM simple WHERE rank = 1) AS share FROM simple GROUP BY 1) WHERE share < 0.2""")
def _(spark, d):
    return rounded(B.rare_algorithms(B.rank_simple(bench(spark, d)), 0.2), "share")


@query("best_algorithm", f"""WITH {BENCH}, {SIMPLE} SELECT {C2}, regexp_replace(algorithm, '_k[0-9]+$', '') AS algorithm, round(error, 6) AS error
  FROM (SELECT *, row_number() OVER (PARTITION BY {C2} ORDER BY rank) AS n FROM simple WHERE algorithm <> 'mean') WHERE n = 1""")
def _(spark, d):
    return rounded(B.best_algorithm(bench(spark, d), excluded=["mean"]), "error")


LABELS = f"lab AS (SELECT asg.dataset, asg.cluster_id, series_id, label FROM asg JOIN mono ON mono.dataset = asg.dataset AND mono.cluster_id = asg.cluster_id)"


@query("label_clusters")
def _(spark, d):
    """All imputers compete."""
    return L.label_clusters(clustered_month(spark, d, None), assignment(spark, d))


@query("label_clusters_single", f"WITH {BENCH}, {VOTE}, {COLL}, {MONO}, {LABELS} SELECT * FROM lab")
def _(spark, d):
    return L.label_clusters(clustered_month(spark, d, None), assignment(spark, d), algorithms=L.SINGLE)


#: The series that each cluster's imputers see: its own first ones, some of its end, and scattered others.
CONTEXT = f"""sz AS (SELECT dataset, cluster_id, count(*) AS size FROM asg GROUP BY 1, 2),
  tot AS (SELECT dataset, count(*) AS total FROM asg GROUP BY 1),
  inn AS (SELECT asg.*, size, row_number() OVER (PARTITION BY asg.dataset, asg.cluster_id ORDER BY series_id) AS pos,
    greatest(5 - (least(size, 2) + least(total - size, 10)), 0) AS lack FROM asg JOIN sz ON sz.dataset = asg.dataset AND sz.cluster_id = asg.cluster_id
    JOIN tot ON tot.dataset = asg.dataset),
  rnd AS (SELECT sz.dataset, sz.cluster_id, o.series_id, row_number() OVER (PARTITION BY sz.dataset, sz.cluster_id
     ORDER BY ((o.series_id % 10007) * 7919 + 104729) % 10007, o.series_id) AS rn
    FROM sz JOIN asg o ON o.dataset = sz.dataset AND o.cluster_id <> sz.cluster_id),
  sel AS (SELECT dataset, cluster_id, series_id FROM inn WHERE (lack > 0 AND size - 2 < lack) OR pos <= 2 OR pos > size - lack
    UNION ALL SELECT dataset, cluster_id, series_id FROM rnd WHERE rn <= 10),
  ctxcells AS (SELECT sel.dataset, sel.cluster_id, sel.series_id, sm.t, sm.value FROM sel JOIN sm ON sm.dataset = sel.dataset AND sm.series_id = sel.series_id)"""
SEEN = [q.replace(" cm ", " ctxcells ") for q in (SIB, REG, KNN, PATTERN)]
TEN = f"""{CM_GAPS}, {CONTEXT}, {MK}, {CTX}, {SEEN[0]}, {SEEN[3]},
  imp AS ({" UNION ALL ".join(one(a) for a in FILL)} UNION ALL {SEEN[1]} UNION ALL {SEEN[2]} UNION ALL SELECT * FROM pat), {ERR}"""


@query("label_clusters_ten", f"WITH {TEN}, {VOTE}, {COLL}, {MONO}, {LABELS} SELECT * FROM lab")
def _(spark, d):
    """The ten imputers that SQL can express compete, on the selected series."""
    ten = (*L.SINGLE, "regression", "knn_series", "pattern_knn")
    return L.label_clusters(clustered_month(spark, d, None), assignment(spark, d), algorithms=ten)


@query("bench_errors_ten", f"""WITH {TEN} SELECT dataset, cluster_id, algorithm, miss_perc, round(mae, 4) AS mae, round(rmse, 4) AS rmse FROM bench""")
def _(spark, d):
    """Errors behind ``label_clusters_ten``."""
    ten = (*L.SINGLE, "regression", "knn_series", "pattern_knn")
    bench = L.selected_bench(clustered_month(spark, d, None), assignment(spark, d), algorithms=ten)
    # regressions on few cells lose digits with the order of their sums
    return bench.select("dataset", "cluster_id", "algorithm", "miss_perc", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))

"""Cluster traits, decomposition and topology features."""

from pyspark.sql import functions as F

from gapmend.catalog.base import ASG, CM, ES, SM, assignment, clustered_month, embedding_series, query, rounded, supplier_month
from gapmend.catalog.q2_series import PAIRS
from gapmend.catalog.q4_stats import G, P, RUNS, feature, long_sql
from gapmend.catalog.q5_signal import levinson_sql
from gapmend.functions.columns import r6
from gapmend.operators import rules as R, series as S
from gapmend.operators.features import decomp as D, stats as X, topology as T, traits as K

Q = "PARTITION BY dataset, series_id"


@query("kiviat_length", f"WITH {SM} SELECT dataset, series_id, count(*) AS length FROM sm GROUP BY 1, 2")
def _(spark, d):
    return K.length(supplier_month(spark, d))


QS = f"""qs AS (SELECT dataset, series_id, quantile_cont(value, [0.01, 0.25, 0.75, 0.99]) q, count(*)::DOUBLE n, avg(value) mu, stddev_samp(value) sd FROM cm {G}),
  jp AS (SELECT *, value - lag(value) OVER o AS jump FROM cm {P}),
  jq AS (SELECT dataset, series_id, quantile_cont(jump, [0.25, 0.75]) j FROM jp {G}),
  es1 AS (SELECT *, sqrt(-2 * ln(0.3 / (2 * n))) s FROM qs),
  es2 AS (SELECT *, s - (2.515517 + 0.802853 * s + 0.010328 * s * s) / (1 + 1.432788 * s + 0.189269 * s * s + 0.001308 * s * s * s) z FROM es1),
  es3 AS (SELECT *, z + z * (z * z + 1) / (4 * (n - 2)) + z * (5 * pow(z, 4) + 16 * z * z + 3) / (96 * (n - 2) * (n - 2)) tv FROM es2),
  fl AS (SELECT jp.*, value < q[1] OR value > q[4] AS a1, value < q[2] - (q[3] - q[2]) * 1.5 OR value > q[3] + (q[3] - q[2]) * 1.5 AS a2,
    coalesce(jump > j[2] + (j[2] - j[1]) * 3.0, false) AS a3, coalesce(abs(value - mu) > (n - 1) * tv / sqrt(n * (n - 2 + tv * tv)) * sd, false) AS a4
    FROM jp JOIN es3 ON es3.dataset = jp.dataset AND es3.series_id = jp.series_id JOIN jq ON jq.dataset = jp.dataset AND jq.series_id = jp.series_id)"""

for name, col, fn in (("anomaly_quantile", "a1", K.anomaly_quantile), ("anomaly_iqr", "a2", K.anomaly_iqr),
                      ("anomaly_persist", "a3", K.anomaly_persist), ("anomaly_esd", "a4", K.anomaly_esd)):
    @query(name, f"WITH {CM}, {QS} SELECT dataset, series_id, t, value, {col} AS anomaly FROM fl")
    def _(spark, d, fn=fn):
        return fn(supplier_month(spark, d))

IRR = "irr AS (SELECT dataset, cluster_id, avg(h::INT) irregularity, count(*) AS length FROM (SELECT dataset, cluster_id, t, bool_or(a1 OR a2 OR a3 OR a4) h FROM fl GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query("irregularity", f"WITH {CM}, {QS}, {IRR} SELECT dataset, cluster_id, round(irregularity, 6) AS irregularity, length FROM irr")
def _(spark, d):
    return rounded(K.irregularity(clustered_month(spark, d)), "irregularity")


KF = f"""{PAIRS}, kf AS (SELECT irr.dataset, irr.cluster_id, length, irregularity, coalesce(cl, []) AS correlation FROM irr LEFT JOIN
  (SELECT dataset, cluster_id, list(corr ORDER BY a, b) cl FROM pc WHERE corr IS NOT NULL GROUP BY 1, 2) c ON c.dataset = irr.dataset AND c.cluster_id = irr.cluster_id)"""


@query("kiviat_features", f"""WITH {CM}, {QS}, {IRR}, {KF} SELECT kf.dataset, series_id, kf.cluster_id, length, round(irregularity, 6) AS irregularity,
  list_transform(correlation, lambda x: round(x, 6) + 0.0) AS correlation FROM kf JOIN asg ON asg.dataset = kf.dataset AND asg.cluster_id = kf.cluster_id""")
def _(spark, d):
    t = K.cluster_traits(clustered_month(spark, d)).withColumn("correlation", F.transform("correlation", lambda x: r6(x)))
    return rounded(S.propagate_cluster_label(t, assignment(spark, d)), "irregularity")


ST = """st AS (SELECT dataset, cluster_id, length, irregularity, list_aggregate(correlation, 'stddev_pop') sc, list_aggregate(correlation, 'median') md FROM kf),
  bt AS (SELECT dataset, cluster_id, coalesce((length >= 80)::INT, 0) l, coalesce((irregularity > 0.6)::INT, 0) i, coalesce((sc > 0.1)::INT, 0) m, coalesce((md > 0.01)::INT, 0) h FROM st)"""


def traits(spark, d):
    # thresholds are parameters; these split the monthly series into both classes
    return S.binarize_traits(K.summarise_traits(K.cluster_traits(clustered_month(spark, d))), 80, 0.6, 0.1, 0.01)


@query("binarize_kiviat", f"WITH {CM}, {QS}, {IRR}, {KF}, {ST} SELECT dataset, cluster_id, l AS large_ts, i AS irregular_ts, m AS mixed_corr, h AS high_corr FROM bt")
def _(spark, d):
    return traits(spark, d)


_vals = ", ".join(f"({p}, '{n}', {0.25 * e}, {a}, {b}, {c}, {h})" for p, (n, e, a, b, c, h) in enumerate(R.STRENGTHS))
RR = f"""rr AS (SELECT dataset, cluster_id, al AS algorithm, (e + l * w1 + i * w2 + m * w3 + h * w4)::DOUBLE AS score,
  row_number() OVER (PARTITION BY dataset, cluster_id ORDER BY e + l * w1 + i * w2 + m * w3 + h * w4 DESC, p)::INTEGER AS rank
  FROM bt CROSS JOIN (VALUES {_vals}) v(p, al, e, w1, w2, w3, w4))"""


@query("kiviat_rules_ranking", f"WITH {CM}, {QS}, {IRR}, {KF}, {ST}, {RR} SELECT * FROM rr")
def _(spark, d):
    return R.rules_ranking(traits(spark, d))


@query("kiviat_rules_label", f"WITH {CM}, {QS}, {IRR}, {KF}, {ST}, {RR} SELECT asg.dataset, series_id, asg.cluster_id, algorithm AS label FROM rr JOIN asg ON asg.dataset = rr.dataset AND asg.cluster_id = rr.cluster_id WHERE rank = 1")
def _(spark, d):
    return S.propagate_cluster_label(R.rules_label(traits(spark, d)), assignment(spark, d))


# --- decomposition ------------------------------------------------------------------

feature("k_chunk_stats", f"""WITH {ES}, g AS (SELECT dataset, series_id, t // 20 c, var_pop(value) v, avg(value) m FROM es GROUP BY 1, 2, 3),
  w AS (SELECT dataset, series_id, var_pop(v) a, var_pop(m) b FROM g {G}) """ + long_sql("w", {"lumpiness": "a", "stability": "b"}), D.chunk_stats,
        lambda s, d: embedding_series(s, d).drop("cluster_id"))

feature("k_simple", f"""WITH {SM}, c AS (SELECT *, lead(value) OVER o nx, avg(value) OVER p mu, quantile_cont(value, 0.5) OVER p md, min(value) OVER p lo, max(value) OVER p hi FROM sm {P}),
  sd AS (SELECT dataset, series_id, t, lo, hi, coalesce(least(floor((value - lo) / nullif((hi - lo) / 10, 0)), 9), 0) AS side FROM c), {RUNS},
  fs AS (SELECT dataset, series_id, max(len) v FROM rn {G}),
  hm AS (SELECT dataset, series_id, lo + (hi - lo) / 10 * side v FROM (SELECT *, row_number() OVER (PARTITION BY dataset, series_id ORDER BY c DESC, side) r FROM
     (SELECT dataset, series_id, lo, hi, side, count(*) c FROM sd GROUP BY 1, 2, 3, 4, 5)) WHERE r = 1),
  b AS (SELECT dataset, series_id, avg(value) a1, var_pop(value) a2, count(*) a3, stddev_pop(nx - value) a4, count(*) FILTER (WHERE (value > md) <> (nx > md)) a5, avg((value > mu)::INT) a6 FROM c {G}),
  w AS (SELECT b.*, fs.v a7, hm.v a8 FROM b JOIN fs ON fs.dataset = b.dataset AND fs.series_id = b.series_id JOIN hm ON hm.dataset = b.dataset AND hm.series_id = b.series_id) """
        + long_sql("w", {"mean": "a1", "var": "a2", "length": "a3", "std1st_der": "a4", "crossing_points": "a5", "binarize_mean": "a6", "flat_spots": "a7", "histogram_mode": "a8"}), D.simple)

_r = ", ".join(f"coalesce(max(r) FILTER (WHERE k = {k}), 0) r{k}" for k in range(1, 11))
KA = f"""dd AS (SELECT dataset, series_id, t, value y, value - lag(value) OVER o d1, value - 2 * lag(value) OVER o + lag(value, 2) OVER o d2 FROM sm {P}),
  un AS (SELECT dataset, series_id, t, 'y' kind, y v FROM dd UNION ALL SELECT dataset, series_id, t, 'diff1y', d1 FROM dd WHERE d1 IS NOT NULL
    UNION ALL SELECT dataset, series_id, t, 'diff2y', d2 FROM dd WHERE d2 IS NOT NULL),
  ce AS (SELECT *, v - avg(v) OVER (PARTITION BY dataset, series_id, kind) x, count(*) OVER (PARTITION BY dataset, series_id, kind) n FROM un),
  rf AS (SELECT a.dataset, a.series_id, a.kind, b.t - a.t k, sum(a.x * b.x) c, max(a.n) n FROM ce a JOIN ce b ON a.series_id = b.series_id AND a.kind = b.kind AND b.t >= a.t GROUP BY 1, 2, 3, 4),
  rg AS (SELECT *, c / nullif(max(c) FILTER (WHERE k = 0) OVER (PARTITION BY dataset, series_id, kind), 0) r FROM rf),
  w AS (SELECT dataset, series_id, kind, {_r} FROM rg GROUP BY 1, 2, 3), {levinson_sql('w', lambda k: f'r{k}', 7)},
  nb AS (SELECT *, lag(r) OVER (PARTITION BY dataset, series_id ORDER BY k) pv, lead(r) OVER (PARTITION BY dataset, series_id ORDER BY k) nx FROM rg WHERE kind = 'y'),
  fm AS (SELECT dataset, series_id, coalesce(min(k) FILTER (WHERE r < pv AND r < nx), max(n)) a, coalesce(min(k) FILTER (WHERE round(r, 9) <= 0), max(n)) b FROM nb {G})"""
_sq = " + ".join(f"r{k} * r{k}" for k in range(1, 6))
_pq = " + ".join(f"coalesce(p{k} * p{k}, 0)" for k in range(1, 6))
feature("k_acf", f"""WITH {SM}, {KA} SELECT dataset, series_id, feature, round(value, 6) + 0.0 AS value FROM (
  SELECT dataset, series_id, kind || '_acf1' AS feature, r1::DOUBLE AS value FROM l7 UNION ALL SELECT dataset, series_id, kind || '_acf5', {_sq} FROM l7
  UNION ALL SELECT dataset, series_id, kind || '_pacf5', {_pq} FROM l7 UNION ALL SELECT dataset, series_id, 'seas_acf1', r7 FROM l7 WHERE kind = 'y'
  UNION ALL SELECT dataset, series_id, 'seas_pacf1', coalesce(p7, 0) FROM l7 WHERE kind = 'y' UNION ALL SELECT dataset, series_id, 'firstmin_ac', a FROM fm
  UNION ALL SELECT dataset, series_id, 'firstzero_ac', b FROM fm)""", D.acf_profile)

feature("k_level_shift", f"""WITH {SM}, c AS (SELECT dataset, series_id, t, max(t) OVER p tm, round(abs(avg(value) OVER ({Q} ORDER BY t ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
    - avg(value) OVER ({Q} ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), 9) j FROM sm {P}),
  w AS (SELECT dataset, series_id, max(j) s, arg_min(t, {{'o': -j, 't': t}}) i FROM c WHERE t >= 20 AND t + 19 <= tm {G}) """
        + long_sql("w", {"level_shift_idx": "i", "level_shift_size": "s"}), D.level_shift)

feature("k_trend_season", f"""WITH {SM}, c AS (SELECT *, avg(value) OVER ({Q} ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) tr, t % 7 ph FROM sm),
  s0 AS (SELECT *, value - tr dt, avg(value - tr) OVER (PARTITION BY dataset, series_id, ph) - avg(value - tr) OVER ({Q}) se FROM c), r AS (SELECT *, dt - se re FROM s0),
  lo AS (SELECT *, count(*) OVER ({Q}) - 1 m, sum(re) OVER ({Q}) s1, sum(re * re) OVER ({Q}) s2 FROM r),
  w AS (SELECT dataset, series_id, coalesce(greatest(0, 1 - var_pop(re) / nullif(var_pop(tr + re), 0)), 0) a, coalesce(greatest(0, 1 - var_pop(re) / nullif(var_pop(se + re), 0)), 0) b,
    var_pop((s2 - re * re) / m - pow((s1 - re) / m, 2)) c, arg_min(ph, {{'o': -round(se, 9), 'p': ph}}) d, arg_min(ph, {{'o': round(se, 9), 'p': ph}}) e,
    covar_pop(t, value) / nullif(var_pop(t) * stddev_pop(value), 0) f FROM lo {G}) """
        + long_sql("w", {"trend_strength": "a", "seasonality_strength": "b", "spikiness": "c", "peak": "d", "trough": "e", "linearity": "f"}), D.trend_season)

feature("k_kpss", f"""WITH {SM}, c AS (SELECT dataset, series_id, t, value - avg(value) OVER p x, count(*) OVER p n FROM sm {P}),
  cu AS (SELECT *, sum(x) OVER ({Q} ORDER BY t ROWS UNBOUNDED PRECEDING) cs, {', '.join(f'lead(x, {k}) OVER o x{k}' for k in range(1, 4))} FROM c {P}),
  w AS (SELECT dataset, series_id, sum(cs * cs) / nullif(pow(max(n), 2) * (sum(x * x) + 2 * (0.75 * sum(x * x1) + 0.5 * sum(x * x2) + 0.25 * sum(x * x3))) / max(n), 0) v FROM cu {G}) """
        + long_sql("w", {"unitroot_kpss": "v"}), D.kpss)
feature("k_heterogeneity", None, D.heterogeneity)

_ld = ", ".join(f"lead(value, {k}) OVER o - value d{k}" for k in range(2, 20))
feature("k_entropy_hurst", f"""WITH {SM}, c AS (SELECT dataset, series_id, t, value - avg(value) OVER p x, count(*) OVER p n FROM sm {P}),
  pw AS (SELECT dataset, series_id, k, pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2) p FROM c CROSS JOIN (SELECT unnest(range(1, 2000)) k) WHERE k <= n // 2 GROUP BY 1, 2, 3),
  sh AS (SELECT *, p / nullif(sum(p) OVER (PARTITION BY dataset, series_id), 0) q, count(*) OVER (PARTITION BY dataset, series_id) m FROM pw),
  e AS (SELECT dataset, series_id, sum(CASE WHEN q > 1e-15 THEN -q * ln(q) ELSE 0 END) / ln(max(m)) e FROM sh {G}),
  l AS (SELECT dataset, series_id, {_ld} FROM sm {P}),
  sg AS (SELECT dataset, series_id, unnest([{', '.join(f'ln(nullif(stddev_pop(d{k}), 0))' for k in range(2, 20))}]) y, unnest([{', '.join(f'ln({k})' for k in range(2, 20))}]) x FROM l {G}),
  h AS (SELECT dataset, series_id, regr_slope(y, x) h FROM sg WHERE y IS NOT NULL {G}),
  w AS (SELECT e.*, h.h FROM e LEFT JOIN h ON h.dataset = e.dataset AND h.series_id = e.series_id) """ + long_sql("w", {"entropy": "e", "hurst": "h"}), D.entropy_hurst)


# --- topology -----------------------------------------------------------------------

@query("takens_embedding", f"""WITH {SM}, ar AS (SELECT dataset, series_id, list(value ORDER BY t) x, count(*) n FROM sm GROUP BY 1, 2),
  pr AS (SELECT *, greatest(least(50, n // dl), 2) dm FROM (SELECT *, greatest(least(30, n // 3), 1) dl FROM ar)),
  st AS (SELECT *, unnest(range(0, n - (dm - 1) * dl, 10)) s FROM pr)
  SELECT dataset, series_id, s // 10 AS point, list_transform(range(0, dm), lambda i: x[s + i * dl + 1]) AS coords FROM st""")
def _(spark, d):
    return T.takens_embedding(supplier_month(spark, d))


@query("embedding_pca")
def _(spark, d):
    return T.embedding_pca(T.takens_embedding(supplier_month(spark, d))).withColumn("coords", F.transform("coords", lambda x: r6(x)))


@query("persistence_entropy_h0")
def _(spark, d):
    return rounded(T.topology(supplier_month(spark, d)), "value")


@query("extract_for_new_series", f"""WITH {ES}, a AS (SELECT dataset, series_id, avg(value) m, max(value) mx, sum(value * value) e, regr_slope(value, t) s FROM es GROUP BY 1, 2)
  SELECT dataset, series_id, round(m, 6) + 0.0 AS mean_stats, round(mx, 6) + 0.0 AS maximum_stats, round(e, 6) AS abs_energy_stats, round(s, 6) + 0.0 AS "slope_trend" FROM a""")
def _(spark, d):
    s = embedding_series(spark, d).drop("cluster_id")
    parts = S.suffix_features(X.basic(s), "_stats").unionByName(
        S.suffix_features(X.linear_trend(s).withColumn("feature", F.regexp_extract("feature", '"(.*)"', 1)), "_trend"))
    wanted = ["mean_stats", "maximum_stats", "abs_energy_stats", "slope_trend"]
    return rounded(parts.groupBy("dataset", "series_id").pivot("feature", wanted).agg(F.first("value")), *wanted)

"""Catch22 measures of the z-normalised embedding series."""

from gapmend.catalog.base import ES, embedding_series
from gapmend.catalog.q4_stats import G, feature, long_sql
from gapmend.operators.features import catch22 as C
from gapmend.operators.series import znormalize

P = "WINDOW p AS (PARTITION BY dataset, series_id), o AS (PARTITION BY dataset, series_id ORDER BY t)"
ZS = f"{ES}, zs AS (SELECT dataset, series_id, t, (value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0) AS value, count(*) OVER p AS n FROM es {P})"
AC = """acv AS (SELECT a.dataset, a.series_id, b.t - a.t AS k, sum(a.value * b.value) AS c, max(a.n) n FROM zs a JOIN zs b ON a.series_id = b.series_id AND b.t >= a.t GROUP BY 1, 2, 3),
  ac AS (SELECT dataset, series_id, k, n, c / max(c) FILTER (WHERE k = 0) OVER p AS r FROM acv WINDOW p AS (PARTITION BY dataset, series_id))"""
FZ = f"fz AS (SELECT dataset, series_id, coalesce(min(k) FILTER (WHERE round(r, 9) <= 0), max(n)) AS tau FROM ac {G})"


def zs(spark, d):
    return znormalize(embedding_series(spark, d).drop("cluster_id"))


def c22(name, sql, fn):
    feature("c22_" + name, sql, fn, zs)


def mode_sql(b):
    return f"""SELECT dataset, series_id, 'DN_HistogramMode_{b}' AS feature, avg(lo + (hi - lo) / {b} * (b + 0.5)) AS value FROM (
      SELECT dataset, series_id, lo, hi, least(floor((value - lo) / nullif((hi - lo) / {b}, 0)), {b - 1}) b, count(*) c, max(count(*)) OVER (PARTITION BY dataset, series_id) mc
      FROM (SELECT *, min(value) OVER p lo, max(value) OVER p hi FROM zs {P}) GROUP BY 1, 2, 3, 4, 5) WHERE c = mc {G}"""


c22("histogram_mode", f"WITH {ZS} SELECT dataset, series_id, feature, round(value, 6) + 0.0 AS value FROM ({mode_sql(5)} UNION ALL {mode_sql(10)})", C.histogram_mode)

c22("acf", f"""WITH {ZS}, {AC}, s AS (SELECT *, lead(r) OVER o nx, lag(r) OVER o pv FROM ac WINDOW o AS (PARTITION BY dataset, series_id ORDER BY k)),
  e AS (SELECT dataset, series_id, coalesce(arg_min(k + (exp(-1) - r) / (nx - r), k) FILTER (WHERE k < n - 2 AND nx < exp(-1)), max(n)) f1,
     coalesce(min(k) FILTER (WHERE r < pv AND r < nx), max(n)) fm FROM s {G}),
  pr AS (SELECT a.dataset, a.series_id, b.t - a.t AS k, max(a.n) n, covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) r FROM zs a JOIN zs b ON a.series_id = b.series_id
     AND b.t - a.t BETWEEN 1 AND least(40, ceil(a.n / 2)) GROUP BY 1, 2, 3),
  am AS (SELECT *, -0.5 * ln(1 - r * r) v FROM pr), al AS (SELECT *, lag(v) OVER o pv, lead(v) OVER o nx FROM am WINDOW o AS (PARTITION BY dataset, series_id ORDER BY k)),
  g AS (SELECT dataset, series_id, coalesce(min(k) FILTER (WHERE v < pv AND v < nx) - 1, max(k)) fmmi FROM al {G}),
  w AS (SELECT e.*, fmmi FROM e JOIN g ON e.dataset = g.dataset AND e.series_id = g.series_id) """
    + long_sql("w", {"CO_f1ecac": "f1", "CO_FirstMin_ac": "fm", "IN_AutoMutualInfoStats_40_gaussian_fmmi": "fmmi"}), C.acf_summaries)

c22("ami", f"""WITH {ZS}, b AS (SELECT dataset, series_id, least(floor((value - lo) / ((hi - lo) / 5)), 4) p, least(floor((nx - lo) / ((hi - lo) / 5)), 4) q
    FROM (SELECT *, min(value) OVER p - 0.1 lo, max(value) OVER p + 0.1 hi, lead(value, 2) OVER o nx FROM zs {P}) WHERE nx IS NOT NULL),
  j AS (SELECT dataset, series_id, p, q, count(*) c FROM b GROUP BY 1, 2, 3, 4),
  m AS (SELECT *, sum(c) OVER (PARTITION BY dataset, series_id) s, sum(c) OVER (PARTITION BY dataset, series_id, p) cp, sum(c) OVER (PARTITION BY dataset, series_id, q) cq FROM j),
  w AS (SELECT dataset, series_id, sum(c / s * ln((c / s) / ((cp / s) * (cq / s)))) v FROM m {G}) """ + long_sql("w", {"CO_HistogramAMI_even_2_5": "v"}), C.histogram_ami)

c22("diff", f"""WITH {ZS}, l AS (SELECT *, lead(value) OVER o - value dx FROM zs {P}), w AS (SELECT dataset, series_id, avg(dx * dx * dx) a,
   avg((abs(dx) * 1000 > 40)::INT) FILTER (WHERE dx IS NOT NULL) b FROM l {G}) """ + long_sql("w", {"CO_trev_1_num": "a", "MD_hrv_classic_pnn40": "b"}), C.differences)

c22("stretch", f"""WITH {ZS}, l AS (SELECT *, avg(value) OVER p mu, lead(value) OVER o nx FROM zs {P}),
  u AS (SELECT dataset, series_id, max(t - pb) v FROM (SELECT *, coalesce(lag(t) OVER o, 0) pb FROM l WHERE nx IS NOT NULL AND (value <= mu OR t = n - 2) {P}) {G}),
  w AS (SELECT dataset, series_id, max(t - pb) v FROM (SELECT *, coalesce(lag(t) OVER o, 0) pb FROM l WHERE nx IS NOT NULL AND (nx >= value OR t = n - 2) {P}) {G}),
  z AS (SELECT u.dataset, u.series_id, u.v a, w.v b FROM u JOIN w ON u.series_id = w.series_id) """
    + long_sql("z", {"SB_BinaryStats_mean_longstretch1": "a", "SB_BinaryStats_diff_longstretch0": "b"}), C.stretches)


def cut_sql(q):
    return f"(s[floor(m * {q} - 0.5)::INT + 1] + (m * {q} - 0.5 - floor(m * {q} - 0.5)) * (s[least(ceil(m * {q} - 0.5)::INT, m - 1) + 1] - s[floor(m * {q} - 0.5)::INT + 1]))"


def words_sql(src, out):
    return f"""{out}q AS (SELECT *, {cut_sql(1 / 3)} q1, {cut_sql(2 / 3)} q2 FROM (SELECT dataset, series_id, list(value ORDER BY value) s, count(*) m FROM {src} {G})),
  {out}l AS (SELECT c.dataset, c.series_id, t, CASE WHEN value <= q1 THEN 0 WHEN value <= q2 THEN 1 ELSE 2 END a FROM {src} c JOIN {out}q q ON c.series_id = q.series_id),
  {out} AS (SELECT dataset, series_id, a, b, count(*) c FROM (SELECT *, lead(a) OVER o b FROM {out}l {P}) WHERE b IS NOT NULL GROUP BY 1, 2, 3, 4)"""


c22("motif", f"""WITH {ZS}, {AC}, {FZ}, dn AS (SELECT zs.dataset, zs.series_id, t, value FROM zs JOIN fz ON fz.series_id = zs.series_id WHERE t % tau = 0), {words_sql('zs', 'wa')}, {words_sql('dn', 'wb')},
  h AS (SELECT dataset, series_id, -sum(c / s * ln(c / s)) v FROM (SELECT *, sum(c) OVER (PARTITION BY dataset, series_id) s FROM wa) {G}),
  full9 AS (SELECT fz.dataset, fz.series_id, i, j, coalesce(c, 0) c FROM fz CROSS JOIN (SELECT unnest([0,1,2]) i) CROSS JOIN (SELECT unnest([0,1,2]) j) LEFT JOIN wb ON wb.series_id = fz.series_id AND a = i AND b = j),
  tr AS (SELECT dataset, series_id, sum(v) v FROM (SELECT dataset, series_id, j, var_samp(c / s) v FROM (SELECT *, sum(c) OVER (PARTITION BY dataset, series_id) s FROM full9) GROUP BY 1, 2, 3) {G}),
  z AS (SELECT h.dataset, h.series_id, h.v a, tr.v b FROM h JOIN tr ON h.series_id = tr.series_id) """
    + long_sql("z", {"SB_MotifThree_quantile_hh": "a", "SB_TransitionMatrix_3ac_sumdiagcov": "b"}), C.motifs)

c22("local_simple", f"""WITH {ZS}, {AC}, {FZ}, dx AS (SELECT dataset, series_id, t, lead(value) OVER o - value v, n FROM zs {P}),
  dc AS (SELECT dataset, series_id, t, n, v - avg(v) OVER (PARTITION BY dataset, series_id) v FROM dx WHERE v IS NOT NULL),
  rc AS (SELECT a.dataset, a.series_id, b.t - a.t k, sum(a.v * b.v) c, max(a.n) n FROM dc a JOIN dc b ON a.series_id = b.series_id AND b.t >= a.t GROUP BY 1, 2, 3),
  rn AS (SELECT *, c / max(c) FILTER (WHERE k = 0) OVER (PARTITION BY dataset, series_id) r FROM rc),
  rz AS (SELECT dataset, series_id, coalesce(min(k) FILTER (WHERE round(r, 9) <= 0), max(n) - 1) rt FROM rn {G}),
  m3 AS (SELECT dataset, series_id, stddev_samp(value - (l1 + l2 + l3) / 3) sd FROM (SELECT *, lag(value, 1) OVER o l1, lag(value, 2) OVER o l2, lag(value, 3) OVER o l3 FROM zs {P}) {G}),
  z AS (SELECT fz.dataset, fz.series_id, rt / tau a, sd b FROM fz JOIN rz ON rz.series_id = fz.series_id JOIN m3 ON m3.series_id = fz.series_id) """
    + long_sql("z", {"FC_LocalSimple_mean1_tauresrat": "a", "FC_LocalSimple_mean3_stderr": "b"}), C.local_simple)


def outlier_sql(name, sign):
    return f"""{name}y AS (SELECT dataset, series_id, t, n, {sign} * value y, max({sign} * value) OVER p top, count(*) FILTER (WHERE {sign} * value >= 0) OVER p tot FROM zs {P}),
  {name}j AS (SELECT dataset, series_id, j, median(t + 1) / (max(n) / 2.0) - 1 mid, count(*) hs, max(tot) tot, max(nt) nt FROM
    (SELECT *, floor(top / 0.01::DOUBLE)::INT + 1 nt, unnest(range(0, floor(top / 0.01::DOUBLE)::INT + 1)) j FROM {name}y) WHERE y >= j * 0.01::DOUBLE GROUP BY 1, 2, 3),
  {name}l AS (SELECT *, least(coalesce(max(j) FILTER (WHERE (hs - 1) * 100.0 / tot > 2) OVER p, 0), coalesce(min(j) FILTER (WHERE hs <= 1) OVER p, nt - 1)) lim FROM {name}j {P.split(', o AS')[0]}),
  {name} AS (SELECT dataset, series_id, median(mid) v FROM {name}l WHERE j <= lim {G})"""


c22("outlier", f"WITH {ZS}, {outlier_sql('op', 1)}, {outlier_sql('om', -1)}, z AS (SELECT op.dataset, op.series_id, op.v a, om.v b FROM op JOIN om ON op.series_id = om.series_id) "
    + long_sql("z", {"DN_OutlierInclude_p_001_mdrmd": "a", "DN_OutlierInclude_n_001_mdrmd": "b"}), C.outliers)

c22("embed", None, C.embedding_fit)

c22("spectrum", f"""WITH {ZS}, sp AS (SELECT dataset, series_id, k, n, (pow(sum(value * cos(2 * pi() * k * t / 64)), 2) + pow(sum(value * sin(2 * pi() * k * t / 64)), 2)) / n
     * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / (2 * pi()) s FROM zs CROSS JOIN (SELECT unnest(range(33)) k) GROUP BY 1, 2, 3, 4),
  cu AS (SELECT *, sum(s) OVER (PARTITION BY dataset, series_id ORDER BY k ROWS UNBOUNDED PRECEDING) cs, sum(s) OVER (PARTITION BY dataset, series_id) tot FROM sp),
  w AS (SELECT dataset, series_id, sum(s) FILTER (WHERE k < 6) * 2 * pi() / 64 a, min(k) FILTER (WHERE round(cs, 9) > round(tot / 2, 9)) * 2 * pi() / 64 b FROM cu {G}) """
    + long_sql("w", {"SP_Summaries_welch_rect_area_5_1": "a", "SP_Summaries_welch_rect_centroid": "b"}), C.spectrum_summaries)

TAUS = C.fluctuation_scales(64)


def fluct_sql(name, lag, ranged):
    f = "sqrt(avg(pow(mx - mn, 2)))" if ranged else "sqrt(sum(ss) / sum(m))"
    return f"""{name}c AS (SELECT dataset, series_id, t // {lag} i, sum(value) OVER (PARTITION BY dataset, series_id ORDER BY t ROWS UNBOUNDED PRECEDING) y FROM zs WHERE t % {lag} = 0 AND t // {lag} < n // {lag}),
  {name}s AS (SELECT dataset, series_id, tau, i // tau seg, i % tau x, y FROM {name}c CROSS JOIN (SELECT unnest({TAUS}) tau) WHERE i < ({64 // lag} // tau) * tau),
  {name}r AS (SELECT dataset, series_id, tau, seg, regr_slope(y, x) b, regr_intercept(y, x) a FROM {name}s GROUP BY 1, 2, 3, 4),
  {name}e AS (SELECT s.dataset, s.series_id, s.tau, s.seg, max(y - a - b * x) mx, min(y - a - b * x) mn, sum(pow(y - a - b * x, 2)) ss, count(*) m
    FROM {name}s s JOIN {name}r r ON s.series_id = r.series_id AND s.tau = r.tau AND s.seg = r.seg GROUP BY 1, 2, 3, 4),
  {name}f AS (SELECT dataset, series_id, ln(tau) lt, ln({f}) lf, row_number() OVER (PARTITION BY dataset, series_id ORDER BY tau) - 1 q FROM {name}e GROUP BY 1, 2, tau),
  {name}b AS (SELECT dataset, series_id, i, sqrt(greatest(regr_syy(lf, lt) FILTER (WHERE q < i) - pow(regr_sxy(lf, lt) FILTER (WHERE q < i), 2) / regr_sxx(lf, lt) FILTER (WHERE q < i), 0))
     + sqrt(greatest(regr_syy(lf, lt) FILTER (WHERE q >= i - 1) - pow(regr_sxy(lf, lt) FILTER (WHERE q >= i - 1), 2) / regr_sxx(lf, lt) FILTER (WHERE q >= i - 1), 0)) er
    FROM {name}f CROSS JOIN (SELECT unnest(range(6, {len(TAUS) - 5})) i) GROUP BY 1, 2, 3),
  {name} AS (SELECT dataset, series_id, i / {len(TAUS)}.0 v FROM (SELECT *, row_number() OVER (PARTITION BY dataset, series_id ORDER BY round(er, 9), i) rn FROM {name}b) WHERE rn = 1)"""


c22("fluct", f"WITH {ZS}, {fluct_sql('fa', 1, True)}, {fluct_sql('fb', 2, False)}, z AS (SELECT fa.dataset, fa.series_id, fa.v a, fb.v b FROM fa JOIN fb ON fa.series_id = fb.series_id) "
    + long_sql("z", {"SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": "a", "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": "b"}), C.fluctuation)

c22("periodicity", f"""WITH {ZS}, rg AS (SELECT dataset, series_id, regr_slope(value, t) b, regr_intercept(value, t) a FROM zs {G}), dt AS (SELECT zs.dataset, zs.series_id, t, n, value - a - b * t y FROM zs JOIN rg ON zs.series_id = rg.series_id),
  cv AS (SELECT u.dataset, u.series_id, v.t - u.t - 1 i, avg(u.y * v.y) c FROM dt u JOIN dt v ON u.series_id = v.series_id AND v.t - u.t BETWEEN 1 AND ceil(u.n / 3) GROUP BY 1, 2, 3),
  nb AS (SELECT *, lag(c) OVER o pv, lead(c) OVER o nx FROM cv WINDOW o AS (PARTITION BY dataset, series_id ORDER BY i)),
  lw AS (SELECT *, last_value(CASE WHEN c < pv AND c < nx THEN c END IGNORE NULLS) OVER (PARTITION BY dataset, series_id ORDER BY i ROWS UNBOUNDED PRECEDING) lo FROM nb),
  w AS (SELECT dataset, series_id, coalesce(min(i) FILTER (WHERE c > pv AND c > nx AND c - lo >= 0.01 AND c >= 0), 0) v FROM lw {G}) """
    + long_sql("w", {"PD_PeriodicityWang_th0_01": "v"}), C.periodicity)

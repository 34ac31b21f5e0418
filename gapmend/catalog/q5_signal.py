"""Autocorrelation, spectral and entropy features."""

import math

from gapmend.catalog.base import ES, SM, embedding_series, query, rounded, supplier_month
from gapmend.catalog.q4_stats import G, P, feature, long_sql
from gapmend.operators.features import acf as A, entropy as H, spectral as S

XC = f"xc AS (SELECT dataset, series_id, t, value - avg(value) OVER p AS x, var_pop(value) OVER p AS va, count(*) OVER p AS n FROM sm {P})"
RHO = f"""rho AS (SELECT a.dataset, a.series_id, k, sum(a.x * b.x) / ((max(a.n) - k) * nullif(max(a.va), 0)) AS r
  FROM xc a CROSS JOIN (SELECT unnest(range(41)) AS k) JOIN xc b ON a.dataset = b.dataset AND a.series_id = b.series_id AND b.t = a.t + k GROUP BY 1, 2, 3)"""
_acf = {f"autocorrelation__lag_{k}": f"r{k}" for k in range(10)} | {
    'agg_autocorrelation__f_agg_"mean"__maxlag_40': "me", 'agg_autocorrelation__f_agg_"median"__maxlag_40': "md", 'agg_autocorrelation__f_agg_"var"__maxlag_40': "va"}
feature("f_autocorr", f"WITH {SM}, {XC}, {RHO}, w AS (SELECT dataset, series_id, " + ", ".join(f"max(r) FILTER (WHERE k = {k}) r{k}" for k in range(10))
        + f", avg(r) FILTER (WHERE k > 0) me, quantile_cont(r, 0.5) FILTER (WHERE k > 0) md, var_pop(r) FILTER (WHERE k > 0) va FROM rho {G}) " + long_sql("w", _acf), A.autocorr)


def levinson_sql(src, rho, order):
    """CTEs l1 .. l<order> with columns p1 .. p<order> from columns rho(1) .. rho(order)"""
    ctes = [f"l1 AS (SELECT *, {rho(1)} AS p1, {rho(1)} AS f1_1 FROM {src})"]
    for k in range(2, order + 1):
        num = f"({rho(k)} - (" + " + ".join(f"f{k-1}_{j} * {rho(k - j)}" for j in range(1, k)) + "))"
        den = "nullif(1.0 - (" + " + ".join(f"f{k-1}_{j} * {rho(j)}" for j in range(1, k)) + "), 0)"
        ctes.append(f"l{k}a AS (SELECT *, {num} / {den} AS p{k} FROM l{k-1})")
        ctes.append(f"l{k} AS (SELECT *, " + ", ".join(f"f{k-1}_{j} - p{k} * f{k-1}_{k-j} AS f{k}_{j}" for j in range(1, k)) + f", p{k} AS f{k}_{k} FROM l{k}a)")
    return ", ".join(ctes)


_w = "w AS (SELECT dataset, series_id, " + ", ".join(f"max(r) FILTER (WHERE k = {k}) r{k}" for k in range(7)) + f" FROM rho {G})"
feature("f_partial_autocorr", f"WITH {SM}, {XC}, {RHO}, {_w}, {levinson_sql('w', lambda k: f'r{k}', 6)} "
        + long_sql("l6", {"partial_autocorrelation__lag_0": "r0"} | {f"partial_autocorrelation__lag_{k}": f"p{k}" for k in range(1, 7)}), A.partial_autocorr)
feature("f_ar", None, A.ar)
feature("f_adf", None, lambda df: A.adf(df))

_n = f"c AS (SELECT *, count(*) OVER p AS n FROM sm {P})"
_cw = ", ".join(f"round(sum(value * cos(2 * pi() * {k} * t / n)), 9) + 0.0 AS re{k}, round(-sum(value * sin(2 * pi() * {k} * t / n)), 9) + 0.0 AS im{k}" for k in range(8))
_cf = {}
for _k in range(8):
    _cf |= {f'fft_coefficient__attr_"real"__coeff_{_k}': f"re{_k}", f'fft_coefficient__attr_"imag"__coeff_{_k}': f"im{_k}",
            f'fft_coefficient__attr_"abs"__coeff_{_k}': f"sqrt(re{_k} * re{_k} + im{_k} * im{_k})", f'fft_coefficient__attr_"angle"__coeff_{_k}': f"degrees(atan2(im{_k}, re{_k}))"}
feature("f_fft", f"WITH {SM}, {_n}, w AS (SELECT dataset, series_id, {_cw} FROM c {G}) " + long_sql("w", _cf), S.fft_coefficients)

SPEC = """sp AS (SELECT dataset, series_id, k, sqrt(pow(sum(value * cos(2 * pi() * k * t / n)), 2) + pow(sum(value * sin(2 * pi() * k * t / n)), 2)) AS mag
   FROM c CROSS JOIN (SELECT unnest(range(2000)) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3)"""
feature("f_fft_aggregated", f"WITH {SM}, {_n}, {SPEC}, m AS (SELECT dataset, series_id, " + ", ".join(f"sum(mag * pow(k, {p})) / nullif(sum(mag), 0) AS m{p}" for p in (1, 2, 3, 4))
        + f" FROM sp {G}), w AS (SELECT *, m2 - m1 * m1 AS va FROM m) " + long_sql("w", {
            'fft_aggregated__aggtype_"centroid"': "m1", 'fft_aggregated__aggtype_"variance"': "va",
            'fft_aggregated__aggtype_"skew"': "CASE WHEN va >= 0.5 THEN (m3 - 3 * m1 * va - pow(m1, 3)) / pow(va, 1.5) END",
            'fft_aggregated__aggtype_"kurtosis"': "CASE WHEN va >= 0.5 THEN (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * pow(m1, 4)) / (va * va) END"}), S.fft_aggregated)


def welch_sql(k):
    return f"2 * (pow(sum(y * cos(2 * pi() * {k} * t / n)), 2) + pow(sum(y * sin(2 * pi() * {k} * t / n)), 2)) / sum(h * h) AS p{k}"


# the monthly series are shorter than one segment, so one segment covers each of them
feature("f_welch", f"""WITH {SM}, c AS (SELECT dataset, series_id, t, count(*) OVER p AS n, 0.5 - 0.5 * cos(2 * pi() * t / count(*) OVER p) AS h,
   (value - avg(value) OVER p) * (0.5 - 0.5 * cos(2 * pi() * t / count(*) OVER p)) AS y FROM sm {P}),
   w AS (SELECT dataset, series_id, {welch_sql(2)}, {welch_sql(5)} FROM c {G}) """
        + long_sql("w", {"spkt_welch_density__coeff_2": "p2", "spkt_welch_density__coeff_5": "p5"}), S.welch)

_cwt = ", ".join(f"""sum(CASE WHEN {i} + (least({10*w}, n) - 1) // 2 - t >= 0 AND {i} + (least({10*w}, n) - 1) // 2 - t < least({10*w}, n) THEN value * {2.0 / (math.sqrt(3.0 * w) * math.pi ** 0.25)!r}
   * (1.0 - pow({i} + (least({10*w}, n) - 1) // 2 - t - (least({10*w}, n) - 1) / 2.0, 2) / {w*w}.0) * exp(-pow({i} + (least({10*w}, n) - 1) // 2 - t - (least({10*w}, n) - 1) / 2.0, 2) / {2*w*w}.0) END) AS c{w}_{i}"""
                 for w in S.WIDTHS for i in range(15))
feature("f_cwt", f"WITH {SM}, {_n}, w AS (SELECT dataset, series_id, {_cwt} FROM c {G}) "
        + long_sql("w", {f"cwt_coefficients__coeff_{i}__w_{w}__widths_(2, 5, 10, 20)": f"c{w}_{i}" for w in S.WIDTHS for i in range(15)}), S.cwt)

feature("f_entropy_binned", f"""WITH {SM}, c AS (SELECT *, min(value) OVER p lo, max(value) OVER p hi FROM sm {P}),
  b AS (SELECT dataset, series_id, coalesce(least(floor((value - lo) / nullif((hi - lo) / 10, 0)), 9), 0) b, count(*) c FROM c GROUP BY 1, 2, 3),
  w AS (SELECT dataset, series_id, -sum(c / s * ln(c / s)) e FROM (SELECT *, sum(c) OVER (PARTITION BY dataset, series_id) s FROM b) {G}) """
        + long_sql("w", {"binned_entropy__max_bins_10": "e"}), H.binned)

_perm = " UNION ALL ".join(f"""SELECT dataset, series_id, {d} dim, list_transform(list_sort(list_transform(range(0, {d}), lambda i: {{'v': xs[i + 1], 'i': i}})), lambda s: s.i) pat
   FROM (SELECT dataset, series_id, list(value) OVER (PARTITION BY dataset, series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {d - 1} FOLLOWING) xs FROM sm) WHERE len(xs) = {d}""" for d in range(3, 8))
feature("f_entropy_perm", f"""WITH {SM}, pp AS ({_perm}), c AS (SELECT dataset, series_id, dim, pat, count(*) c FROM pp GROUP BY 1, 2, 3, 4)
  SELECT dataset, series_id, 'permutation_entropy__dimension_' || dim || '__tau_1' AS feature, round(-sum(c / s * ln(c / s)), 6) + 0.0 AS value
  FROM (SELECT *, sum(c) OVER (PARTITION BY dataset, series_id, dim) s FROM c) GROUP BY dataset, series_id, dim""", H.permutation)

_near = ", ".join(f"count(*) FILTER (WHERE d2 <= {r} * sd AND v) a{i}, count(*) FILTER (WHERE greatest(d2, d3) <= {r} * sd) b{i}" for i, r in enumerate(H.APEN_R))
feature("f_entropy_approx", f"""WITH {ES}, x AS (SELECT dataset, series_id, t, value x0, lead(value) OVER o x1, lead(value, 2) OVER o x2, stddev_pop(value) OVER p sd, count(*) OVER p n FROM es {P}),
  c AS (SELECT a.dataset, a.series_id, a.t, max(a.n) n, bool_or(a.x2 IS NOT NULL) has3, {_near} FROM (SELECT a.dataset, a.series_id, a.t, a.n, a.x2, a.sd, true v,
      greatest(abs(a.x0 - b.x0), abs(a.x1 - b.x1)) d2, abs(a.x2 - b.x2) d3, b.x2 AS bx2 FROM x a JOIN x b ON a.series_id = b.series_id AND b.x1 IS NOT NULL WHERE a.x1 IS NOT NULL) a GROUP BY 1, 2, 3),
  w AS (SELECT dataset, series_id, {", ".join(f"abs(sum(ln(a{i} / (n - 1))) / max(n - 1) - sum(CASE WHEN has3 THEN ln(b{i} / (n - 2)) END) / max(n - 2)) e{i}" for i in range(5))} FROM c {G}) """
        .replace("greatest(d2, d3) <=", "bx2 IS NOT NULL AND a.x2 IS NOT NULL AND greatest(d2, d3) <=")
        + long_sql("w", {f"approximate_entropy__m_2__r_{r}": f"e{i}" for i, r in enumerate(H.APEN_R)}), H.approximate,
        lambda s, d: embedding_series(s, d).drop("cluster_id"))
feature("f_lempel_ziv", None, H.lempel_ziv)

_b0 = sum(H.BENFORD) / 9
feature("f_benford", f"""WITH {SM}, g AS (SELECT dataset, series_id, regexp_extract(abs(value)::VARCHAR, '[1-9]') dg FROM sm), s AS (SELECT dataset, series_id, d, b,
   avg((dg = d::VARCHAR)::INT) sh FROM g CROSS JOIN (SELECT unnest(range(1, 10)) d, unnest({H.BENFORD}) b) GROUP BY 1, 2, 3, 4),
   w AS (SELECT dataset, series_id, covar_pop(sh, b) / nullif(stddev_pop(sh) * stddev_pop(b), 0) r FROM s {G}) """ + long_sql("w", {"benford_correlation": "r"}), H.benford)

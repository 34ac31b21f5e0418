"""Feature statistics of the monthly supplier series."""

from gapmend.catalog.base import SM, query, rounded, supplier_month
from gapmend.operators.features import stats as X


def long_sql(src, feats):
    items = ", ".join(f"{{'feature': '{n}', 'value': ({e})::DOUBLE}}" for n, e in feats.items())
    return (f"SELECT dataset, series_id, u.feature AS feature, round(u.value, 6) + 0.0 AS value "
            f"FROM (SELECT dataset, series_id, unnest([{items}]) AS u FROM {src})")


def feature(name, sql, fn, series=supplier_month):
    @query(name, sql)
    def _(spark, d):
        return rounded(fn(series(spark, d)), "value")


G = "GROUP BY dataset, series_id"
P = "WINDOW p AS (PARTITION BY dataset, series_id), o AS (PARTITION BY dataset, series_id ORDER BY t)"

feature("f_basic", f"WITH {SM}, w AS (SELECT dataset, series_id, avg(value) a, median(value) b, min(value) c, max(value) d, sum(value) e, count(*) f, var_pop(value) g, stddev_pop(value) h, sqrt(avg(value*value)) i, sum(value*value) j FROM sm {G}) "
        + long_sql("w", dict(zip(["mean", "median", "minimum", "maximum", "sum_values", "length", "variance", "standard_deviation", "root_mean_square", "abs_energy"], "abcdefghij"))), X.basic)

feature("f_shape_moments", f"WITH {SM}, w AS (SELECT dataset, series_id, skewness(value) s, kurtosis(value) k FROM sm {G}) "
        + long_sql("w", {"skewness": "s", "kurtosis": "k"}), X.shape_moments)

feature("f_quantile", f"WITH {SM}, w AS (SELECT dataset, series_id, {', '.join(f'quantile_cont(value, {q}) AS q{i}' for i, q in enumerate(X.QUANTILES))} FROM sm {G}) "
        + long_sql("w", {f"quantile__q_{q}": f"q{i}" for i, q in enumerate(X.QUANTILES)}), X.quantiles)

FLAGS = {"variance_larger_than_standard_deviation": "va > sd"}
FLAGS |= {f"large_standard_deviation__r_{r}": f"sd > {r!r}::DOUBLE * span" for r in X.RATIOS[1:]}
FLAGS |= {f"symmetry_looking__r_{r}": f"abs(mu - med) < {r!r}::DOUBLE * span" for r in X.RATIOS}
feature("f_sd_flags", f"WITH {SM}, w AS (SELECT dataset, series_id, var_pop(value) va, stddev_pop(value) sd, avg(value) mu, median(value) med, max(value)-min(value) span FROM sm {G}) "
        + long_sql("w", {k: f"({e})::INT" for k, e in FLAGS.items()}), X.sd_flags)

feature("f_ratio_sigma", f"WITH {SM}, c AS (SELECT *, avg(value) OVER p mu, stddev_pop(value) OVER p sd FROM sm {P}), w AS (SELECT dataset, series_id, "
        + ", ".join(f"avg((abs(value - mu) > {r} * sd)::INT) AS r{i}" for i, r in enumerate(X.SIGMAS)) + f" FROM c {G}) "
        + long_sql("w", {f"ratio_beyond_r_sigma__r_{r}": f"r{i}" for i, r in enumerate(X.SIGMAS)}), X.ratio_sigma)

CNT = {"count_above_mean": "sum((value > mu)::INT)", "count_below_mean": "sum((value < mu)::INT)", "count_above__t_0": "avg((value >= 0)::INT)",
       "count_below__t_0": "avg((value <= 0)::INT)", "range_count__max_1__min_-1": "sum((value >= -1 AND value < 1)::INT)",
       "range_count__max_1000000000000.0__min_0": "sum((value >= 0 AND value < 1e12)::INT)", "range_count__max_0__min_1000000000000.0": "sum((value >= 1e12 AND value < 0)::INT)",
       "value_count__value_0": "sum((value = 0)::INT)", "value_count__value_1": "sum((value = 1)::INT)", "value_count__value_-1": "sum((value = -1)::INT)"}
feature("f_counts", f"WITH {SM}, c AS (SELECT *, avg(value) OVER p mu FROM sm {P}), w AS (SELECT dataset, series_id, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(CNT.values())) + f" FROM c {G}) "
        + long_sql("w", {k: f"c{i}" for i, k in enumerate(CNT)}), X.counts)

feature("f_duplicates", f"""WITH {SM}, v AS (SELECT dataset, series_id, value, count(*) c FROM sm GROUP BY 1, 2, 3),
  w AS (SELECT dataset, series_id, sum(c) n, count(*) u, count(*) FILTER (WHERE c > 1) ru, coalesce(sum(c) FILTER (WHERE c > 1), 0) rd,
   coalesce(sum(value) FILTER (WHERE c > 1), 0) sv, coalesce(sum(value * c) FILTER (WHERE c > 1), 0) sd, arg_max(c, value) cx, arg_min(c, value) cn FROM v {G}) """
        + long_sql("w", {"has_duplicate": "(ru > 0)::INT", "has_duplicate_max": "(cx > 1)::INT", "has_duplicate_min": "(cn > 1)::INT",
                         "percentage_of_reoccurring_datapoints_to_all_datapoints": "rd / n", "percentage_of_reoccurring_values_to_all_values": "ru / u",
                         "sum_of_reoccurring_values": "sv", "sum_of_reoccurring_data_points": "sd", "ratio_value_number_to_time_series_length": "u / n"}), X.duplicates)

feature("f_locations", f"""WITH {SM}, c AS (SELECT *, max(value) OVER p mx, min(value) OVER p mn, count(*) OVER p n FROM sm {P}),
  w AS (SELECT dataset, series_id, max(n) n, min(t) FILTER (WHERE value = mx) a, max(t) FILTER (WHERE value = mx) b, min(t) FILTER (WHERE value = mn) c, max(t) FILTER (WHERE value = mn) d FROM c {G}) """
        + long_sql("w", {"first_location_of_maximum": "a / n", "last_location_of_maximum": "(b + 1) / n", "first_location_of_minimum": "c / n", "last_location_of_minimum": "(d + 1) / n"}), X.locations)

feature("f_changes", f"""WITH {SM}, c AS (SELECT *, lead(value) OVER o AS nx, lag(value) OVER o AS pv FROM sm {P}),
  w AS (SELECT dataset, series_id, sum(abs(nx - value)) a, avg(abs(nx - value)) b, avg(nx - value) c, avg((nx - 2 * value + pv) / 2) d, sqrt(sum((nx - value) * (nx - value))) e, stddev_pop(value) f FROM c {G}) """
        + long_sql("w", {"absolute_sum_of_changes": "a", "mean_abs_change": "b", "mean_change": "c", "mean_second_derivative_central": "d", "cid_ce__normalize_False": "e",
                         "cid_ce__normalize_True": "coalesce(e / nullif(f, 0), 0)"}), X.changes)

E = X.EDGES
CQ = [(i, j) for i in range(6) for j in range(i + 1, 6)]
_cq = ", ".join(f"coalesce(avg(x) FILTER (WHERE k = {i}{j}), 0) m{i}{j}, coalesce(avg(abs(x)) FILTER (WHERE k = {i}{j}), 0) a{i}{j}, "
                f"coalesce(avg(x * x) FILTER (WHERE k = {i}{j}), 0) s{i}{j}" for i, j in CQ)
_cqf = {}
for _i, _j in CQ:
    for _abs, _m in ((False, "m"), (True, "a")):
        _tail = f"__isabs_{_abs}__qh_{E[_j]}__ql_{E[_i]}"
        _cqf['change_quantiles__f_agg_"mean"' + _tail] = f"{_m}{_i}{_j}"
        _cqf['change_quantiles__f_agg_"var"' + _tail] = f"greatest(s{_i}{_j} - {_m}{_i}{_j} * {_m}{_i}{_j}, 0)"
feature("f_change_quantiles", f"""WITH {SM}, q AS (SELECT dataset, series_id, quantile_cont(value, {E}) qs FROM sm {G}),
  c AS (SELECT *, lead(value) OVER o AS nx FROM sm {P}),
  k AS (SELECT unnest([{', '.join(f'{i}{j}' for i, j in CQ)}]) k, unnest([{', '.join(str(i + 1) for i, j in CQ)}]) i, unnest([{', '.join(str(j + 1) for i, j in CQ)}]) j),
  r AS (SELECT c.dataset, c.series_id, k, CASE WHEN qs[i] < qs[j] AND value BETWEEN qs[i] AND qs[j] AND nx BETWEEN qs[i] AND qs[j] THEN nx - value END AS x
    FROM c JOIN q ON c.dataset = q.dataset AND c.series_id = q.series_id CROSS JOIN k WHERE nx IS NOT NULL),
  w AS (SELECT dataset, series_id, {_cq} FROM r {G}) """ + long_sql("w", _cqf), X.change_quantiles)

RUNS = """rn AS (SELECT dataset, series_id, side, count(*) len FROM (SELECT *, row_number() OVER (PARTITION BY dataset, series_id ORDER BY t)
    - row_number() OVER (PARTITION BY dataset, series_id, side ORDER BY t) g FROM sd) GROUP BY dataset, series_id, side, g)"""
feature("f_strikes", f"""WITH {SM}, sd AS (SELECT dataset, series_id, t, sign(value - avg(value) OVER p) side FROM sm {P}), {RUNS},
  w AS (SELECT dataset, series_id, coalesce(max(len) FILTER (WHERE side = 1), 0) a, coalesce(max(len) FILTER (WHERE side = -1), 0) b FROM rn {G}) """
        + long_sql("w", {"longest_strike_above_mean": "a", "longest_strike_below_mean": "b"}), X.strikes)

feature("f_crossings", f"""WITH {SM}, c AS (SELECT *, lead(value) OVER o AS nx FROM sm {P}), w AS (SELECT dataset, series_id,
  {', '.join(f'count(*) FILTER (WHERE (value > {m}) <> (nx > {m})) AS c{i}' for i, m in enumerate((-1, 0, 1)))} FROM c {G}) """
        + long_sql("w", {f"number_crossing_m__m_{m}": f"c{i}" for i, m in enumerate((-1, 0, 1))}), X.crossings)

feature("f_peaks", f"WITH {SM}, c AS (SELECT *, max(t) OVER p AS tm, " + ", ".join(
    f"max(value) OVER (PARTITION BY dataset, series_id ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) l{n}, "
    f"max(value) OVER (PARTITION BY dataset, series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) r{n}" for n in X.SUPPORTS)
    + f" FROM sm {P}), w AS (SELECT dataset, series_id, " + ", ".join(
        f"count(*) FILTER (WHERE t >= {n} AND t <= tm - {n} AND value > l{n} AND value > r{n}) c{n}" for n in X.SUPPORTS) + f" FROM c {G}) "
    + long_sql("w", {f"number_peaks__n_{n}": f"c{n}" for n in X.SUPPORTS}), X.peaks)

feature("f_energy_chunks", f"WITH {SM}, c AS (SELECT *, ntile(10) OVER o - 1 AS part FROM sm {P}), w AS (SELECT dataset, series_id, " + ", ".join(
    f"coalesce(sum(value * value) FILTER (WHERE part = {i}), 0) / nullif(sum(value * value), 0) AS e{i}" for i in range(10)) + f" FROM c {G}) "
    + long_sql("w", {f"energy_ratio_by_chunks__num_segments_10__segment_focus_{i}": f"e{i}" for i in range(10)}), X.energy_chunks)

feature("f_mass_quantile", f"""WITH {SM}, c AS (SELECT *, round(sum(abs(value)) OVER (PARTITION BY dataset, series_id ORDER BY t ROWS UNBOUNDED PRECEDING)
   / nullif(sum(abs(value)) OVER p, 0), 12) sh, count(*) OVER p n FROM sm {P}), w AS (SELECT dataset, series_id, """ + ", ".join(
    f"(min(t) FILTER (WHERE sh >= {q}) + 1) / max(n) AS q{i}" for i, q in enumerate(X.QUANTILES)) + f" FROM c {G}) "
    + long_sql("w", {f"index_mass_quantile__q_{q}": f"q{i}" for i, q in enumerate(X.QUANTILES)}), X.mass_quantile)

feature("f_nonlinear", f"WITH {SM}, c AS (SELECT *, " + ", ".join(f"lead(value, {k}) OVER o AS x{k}" for k in (1, 2, 3, 4, 6)) + f" FROM sm {P}), w AS (SELECT dataset, series_id, "
        + ", ".join(f"avg(x{2*k} * x{k} * value) c{k}, avg(x{2*k} * x{2*k} * x{k} - x{k} * value * value) r{k}" for k in (1, 2, 3)) + f" FROM c {G}) "
        + long_sql("w", {f"c3__lag_{k}": f"c{k}" for k in (1, 2, 3)} | {f"time_reversal_asymmetry_statistic__lag_{k}": f"r{k}" for k in (1, 2, 3)}), X.nonlinear)


def reg_sql(n="n", sx="sx", sxx="sxx", sy="sy", syy="syy", sxy="sxy"):
    """slope, intercept, r and stderr as SQL, from sums"""
    vx, vy, cxy = f"({sxx} - {sx} * {sx} / {n})", f"({syy} - {sy} * {sy} / {n})", f"({sxy} - {sx} * {sy} / {n})"
    r = f"(CASE WHEN {vy} <= 1e-12 * greatest(abs({syy}), 1.0) THEN 0.0 ELSE greatest(-1.0, least(1.0, {cxy} / sqrt(nullif({vx}, 0) * nullif({vy}, 0)))) END)"
    slope = f"({cxy} / nullif({vx}, 0))"
    return slope, f"(({sy} - {slope} * {sx}) / {n})", r, f"sqrt(greatest((1.0 - {r} * {r}) * {vy}, 0) / nullif({vx}, 0) / nullif({n} - 2, 0))"


def student_sql(t, df):
    """Two-sided Student p-value, integer degrees of freedom, as a finite sum"""
    th = f"atan({t} / sqrt({df}))"
    c2 = f"(cos({th}) * cos({th}))"
    term = (f"list_sum(list_transform(range(0, {df} // 2), lambda j: (CASE WHEN {df} % 2 = 1 THEN cos({th}) ELSE 1.0 END) * "
            f"coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: {c2} * (2 * i - 1 + {df} % 2)::DOUBLE / (2 * i + {df} % 2)), 'product'), 1.0)))")
    return f"greatest(0.0, 1.0 - (CASE WHEN {df} % 2 = 1 THEN ({th} + sin({th}) * coalesce({term}, 0.0)) * 2 / pi() ELSE sin({th}) * {term} END))"


_sl, _ic, _r, _se = reg_sql()
LT = f"""s AS (SELECT dataset, series_id, count(*)::DOUBLE n, sum(t)::DOUBLE sx, sum(t * t)::DOUBLE sxx, sum(value) sy, sum(value * value) syy, sum(t * value) sxy FROM sm {G}),
  r AS (SELECT dataset, series_id, (n - 2)::BIGINT df, {_sl} slope, {_ic} icept, {_r} rv, {_se} se FROM s),
  w AS (SELECT *, abs(rv) * sqrt(df / nullif((1 - rv) * (1 + rv), 0)) tv FROM r)"""
feature("f_linear_trend", f"WITH {SM}, {LT} " + long_sql("w", {'linear_trend__attr_"slope"': "slope", 'linear_trend__attr_"intercept"': "icept", 'linear_trend__attr_"rvalue"': "rv",
        'linear_trend__attr_"stderr"': "se", 'linear_trend__attr_"pvalue"': f"CASE WHEN tv IS NULL THEN 0.0 ELSE {student_sql('tv', 'df')} END"}), X.linear_trend)

_parts = "UNION ALL".join(f""" SELECT dataset, series_id, {c} len, '{k}' kind, t // {c} c, {f}(value) y FROM sm GROUP BY 1, 2, t // {c} """
                          for c in (5, 10) for k, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("var", "var_pop")))
feature("f_agg_linear_trend", f"""WITH {SM}, a AS ({_parts}), s AS (SELECT dataset, series_id, len, kind, count(*)::DOUBLE n, sum(c)::DOUBLE sx, sum(c * c)::DOUBLE sxx, sum(y) sy, sum(y * y) syy, sum(c * y) sxy
    FROM a GROUP BY 1, 2, 3, 4),
  w AS (SELECT dataset, series_id, len, kind, unnest(['slope', 'intercept', 'rvalue', 'stderr']) attr, unnest([{_sl}, {_ic}, {_r}, {_se}]) v FROM s)
  SELECT dataset, series_id, 'agg_linear_trend__attr_"' || attr || '"__chunk_len_' || len || '__f_agg_"' || kind || '"' AS feature, round(v, 6) + 0.0 AS value FROM w""", X.agg_linear_trend)

"""Group statistics of series, in common feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapmend.functions.columns import div, student_two_sided
from gapmend.operators.blocks import neighbours, prefix_sums, runs
from gapmend.operators.features.common import K, centred, chunk_of, regression, to_long, with_stats

QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
SIGMAS = [0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10]
RATIOS = [i * 0.05 for i in range(20)]
EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
SUPPORTS = [1, 3, 5, 10, 50]


def basic(df: DataFrame) -> DataFrame:
    v = F.col("value")
    w = df.groupBy(*K).agg(
        F.avg(v).alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.min(v).alias("minimum"),
        F.max(v).alias("maximum"), F.sum(v).alias("sum_values"), F.count(v).alias("length"), F.var_pop(v).alias("variance"),
        F.stddev_pop(v).alias("standard_deviation"), F.sqrt(F.avg(v * v)).alias("root_mean_square"), F.sum(v * v).alias("abs_energy"))
    return to_long(w, {c: F.col(c) for c in w.columns if c not in K})


def shape_moments(df: DataFrame) -> DataFrame:
    """Bias-adjusted skewness and excess kurtosis; NULL for constant or tiny series."""
    w = df.groupBy(*K).agg(F.count("value").cast("double").alias("n"), F.stddev_pop("value").alias("sd"),
                           F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    n = F.col("n")
    ok = F.col("sd") > 1e-12
    skew = F.when(ok & (n > 2), F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(ok & (n > 3), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return to_long(w, {"skewness": skew, "kurtosis": kurt})


def quantiles(df: DataFrame) -> DataFrame:
    w = df.groupBy(*K).agg(F.percentile("value", F.array(*[F.lit(q) for q in QUANTILES])).alias("q"))
    return to_long(w, {f"quantile__q_{q}": F.col("q")[i] for i, q in enumerate(QUANTILES)})


def sd_flags(df: DataFrame) -> DataFrame:
    w = df.groupBy(*K).agg(
        F.var_pop("value").alias("var"), F.stddev_pop("value").alias("sd"), F.avg("value").alias("mu"),
        F.expr("percentile(value, 0.5)").alias("med"), (F.max("value") - F.min("value")).alias("span"))
    flag = lambda c: c.cast("int")
    out = {"variance_larger_than_standard_deviation": flag(F.col("var") > F.col("sd"))}
    for r in RATIOS[1:]:
        out[f"large_standard_deviation__r_{r}"] = flag(F.col("sd") > F.lit(r) * F.col("span"))
    for r in RATIOS:
        out[f"symmetry_looking__r_{r}"] = flag(F.abs(F.col("mu") - F.col("med")) < F.lit(r) * F.col("span"))
    return to_long(w, out)


def ratio_sigma(df: DataFrame) -> DataFrame:
    c = centred(df)
    w = c.groupBy(*K).agg(*[
        F.avg((F.abs("xc") > F.lit(float(r)) * F.col("sd")).cast("double")).alias(f"r{i}") for i, r in enumerate(SIGMAS)])
    return to_long(w, {f"ratio_beyond_r_sigma__r_{r}": F.col(f"r{i}") for i, r in enumerate(SIGMAS)})


def counts(df: DataFrame) -> DataFrame:
    v = F.col("value")
    c = with_stats(df, mu=F.avg("value"))
    cnt = lambda cond: F.count_if(cond)
    w = c.groupBy(*K).agg(
        cnt(v > F.col("mu")).alias("a"), cnt(v < F.col("mu")).alias("b"), F.avg((v >= 0).cast("double")).alias("c"),
        F.avg((v <= 0).cast("double")).alias("d"), cnt((v >= -1) & (v < 1)).alias("e"), cnt((v >= 0) & (v < 1e12)).alias("f"),
        cnt((v >= 1e12) & (v < 0)).alias("g"), cnt(v == 0).alias("h"), cnt(v == 1).alias("i"), cnt(v == -1).alias("j"))
    names = ["count_above_mean", "count_below_mean", "count_above__t_0", "count_below__t_0", "range_count__max_1__min_-1",
             "range_count__max_1000000000000.0__min_0", "range_count__max_0__min_1000000000000.0", "value_count__value_0",
             "value_count__value_1", "value_count__value_-1"]
    return to_long(w, dict(zip(names, [F.col(x) for x in "abcdefghij"])))


def duplicates(df: DataFrame) -> DataFrame:
    per = df.groupBy(*K, "value").agg(F.count(F.lit(1)).alias("c"))
    v, c = F.col("value"), F.col("c")
    again = c > 1
    w = per.groupBy(*K).agg(
        F.sum(c).alias("n"), F.count(F.lit(1)).alias("u"), F.count_if(again).alias("ru"),
        F.coalesce(F.sum(F.when(again, c)), F.lit(0)).alias("rd"), F.coalesce(F.sum(F.when(again, v)), F.lit(0.0)).alias("sv"),
        F.coalesce(F.sum(F.when(again, v * c)), F.lit(0.0)).alias("sd"), F.max_by(c, v).alias("cmax"), F.min_by(c, v).alias("cmin"))
    n = F.col("n")
    return to_long(w, {
        "has_duplicate": (F.col("ru") > 0).cast("int"), "has_duplicate_max": (F.col("cmax") > 1).cast("int"),
        "has_duplicate_min": (F.col("cmin") > 1).cast("int"),
        "percentage_of_reoccurring_datapoints_to_all_datapoints": F.col("rd") / n,
        "percentage_of_reoccurring_values_to_all_values": F.col("ru") / F.col("u"),
        "sum_of_reoccurring_values": F.col("sv"), "sum_of_reoccurring_data_points": F.col("sd"),
        "ratio_value_number_to_time_series_length": F.col("u") / n})


def locations(df: DataFrame) -> DataFrame:
    v, t = F.col("value"), F.col("t")
    w = df.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(v, (-t).alias("t"))).alias("fmax"), F.max(F.struct(v, t)).alias("lmax"),
        F.min(F.struct(v, t)).alias("fmin"), F.min(F.struct(v, (-t).alias("t"))).alias("lmin"))
    n = F.col("n")
    return to_long(w, {
        "first_location_of_maximum": -F.col("fmax.t") / n, "last_location_of_maximum": (F.col("lmax.t") + 1) / n,
        "first_location_of_minimum": F.col("fmin.t") / n, "last_location_of_minimum": (-F.col("lmin.t") + 1) / n})


def changes(df: DataFrame) -> DataFrame:
    x = F.col("value")
    d = neighbours(df, {"nx": lambda w: F.lead("value").over(w), "pv": lambda w: F.lag("value").over(w)}, 1, 1)
    step = F.col("nx") - x
    w = d.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(step)).alias("sa"), F.avg(F.abs(step)).alias("ma"), F.avg(step).alias("mc"),
        F.avg((F.col("nx") - 2 * x + F.col("pv")) / 2).alias("sec"), F.sqrt(F.sum(step * step)).alias("cid"), F.stddev_pop(x).alias("sd"))
    return to_long(w, {
        "absolute_sum_of_changes": F.col("sa"), "mean_abs_change": F.col("ma"), "mean_change": F.col("mc"),
        "mean_second_derivative_central": F.col("sec"), "cid_ce__normalize_False": F.col("cid"),
        "cid_ce__normalize_True": F.coalesce(div("cid", "sd"), F.lit(0.0))})


def change_quantiles(df: DataFrame) -> DataFrame:
    """Mean and variance of (absolute) changes whose both ends lie in a quantile corridor."""
    q = df.groupBy(*K).agg(F.percentile("value", F.array(*[F.lit(e) for e in EDGES])).alias("q"))
    d = neighbours(df, {"nx": lambda w: F.lead("value").over(w)}, 0, 1).where("nx IS NOT NULL").join(q, K)
    x, y = F.col("value"), F.col("nx")
    aggs, out = [], {}
    for i, lo in enumerate(EDGES):
        for j, hi in enumerate(EDGES):
            if j <= i:
                continue
            a, b = F.col("q")[i], F.col("q")[j]
            inside = (a < b) & (x >= a) & (x <= b) & (y >= a) & (y <= b)
            step = F.when(inside, y - x)
            k = f"{i}{j}"
            aggs += [F.avg(step).alias("m" + k), F.avg(F.abs(step)).alias("a" + k), F.avg(step * step).alias("s" + k)]
            for is_abs, mean in ((False, "m"), (True, "a")):
                mu = F.coalesce(F.col(mean + k), F.lit(0.0))
                tail = f"__isabs_{is_abs}__qh_{hi}__ql_{lo}"
                out['change_quantiles__f_agg_"mean"' + tail] = mu
                out['change_quantiles__f_agg_"var"' + tail] = F.greatest(F.coalesce(F.col("s" + k), F.lit(0.0)) - mu * mu, F.lit(0.0))
    return to_long(d.groupBy(*K).agg(*aggs), out)


def strikes(df: DataFrame) -> DataFrame:
    c = with_stats(df, mu=F.avg("value"))
    side = F.when(F.col("value") > F.col("mu"), 1).when(F.col("value") < F.col("mu"), -1).otherwise(0)
    w = runs(c, side).groupBy(*K).agg(
        F.coalesce(F.max(F.when(F.col("flag") == 1, F.col("length"))), F.lit(0)).alias("up"),
        F.coalesce(F.max(F.when(F.col("flag") == -1, F.col("length"))), F.lit(0)).alias("down"))
    return to_long(w, {"longest_strike_above_mean": F.col("up"), "longest_strike_below_mean": F.col("down")})


def crossings(df: DataFrame, levels=(-1, 0, 1)) -> DataFrame:
    d = neighbours(df, {"nx": lambda w: F.lead("value").over(w)}, 0, 1)
    w = d.groupBy(*K).agg(*[
        F.count_if((F.col("value") > m) != (F.col("nx") > m)).alias(f"c{i}") for i, m in enumerate(levels)])
    return to_long(w, {f"number_crossing_m__m_{m}": F.col(f"c{i}") for i, m in enumerate(levels)})


def peaks(df: DataFrame) -> DataFrame:
    """Values above all n neighbours on each side; only points with n on both sides."""
    exprs = {}
    for n in SUPPORTS:
        exprs[f"l{n}"] = lambda w, n=n: F.max("value").over(w.rowsBetween(-n, -1))
        exprs[f"r{n}"] = lambda w, n=n: F.max("value").over(w.rowsBetween(1, n))
        exprs[f"p{n}"] = lambda w, n=n: F.lag("t", n).over(w).isNotNull() & F.lead("t", n).over(w).isNotNull()
    top = max(SUPPORTS)
    d = neighbours(df, exprs, top, top)
    v = F.col("value")
    w = d.groupBy(*K).agg(*[
        F.count_if(F.col(f"p{n}") & (v > F.col(f"l{n}")) & (v > F.col(f"r{n}"))).alias(f"c{n}") for n in SUPPORTS])
    return to_long(w, {f"number_peaks__n_{n}": F.col(f"c{n}") for n in SUPPORTS})


def energy_chunks(df: DataFrame, parts: int = 10) -> DataFrame:
    c = with_stats(df, n=F.count("value"))
    part = chunk_of(F.col("t"), F.col("n"), parts)
    e = F.col("value") * F.col("value")
    w = c.groupBy(*K).agg(F.sum(e).alias("all"), *[
        F.coalesce(F.sum(F.when(part == i, e)), F.lit(0.0)).alias(f"e{i}") for i in range(parts)])
    return to_long(w, {f"energy_ratio_by_chunks__num_segments_{parts}__segment_focus_{i}": div(f"e{i}", "all") for i in range(parts)})


def mass_quantile(df: DataFrame) -> DataFrame:
    run = prefix_sums(df.withColumn("m", F.abs("value")), {"cum": "m"})
    tot = df.groupBy(*K).agg(F.sum(F.abs("value")).alias("total"), F.count(F.lit(1)).alias("n"))
    share = F.round(div("cum", "total"), 12)
    w = run.join(tot, K).groupBy(*K, "n").agg(*[
        F.min(F.when(share >= q, F.col("t"))).alias(f"t{i}") for i, q in enumerate(QUANTILES)])
    return to_long(w, {f"index_mass_quantile__q_{q}": (F.col(f"t{i}") + 1) / F.col("n") for i, q in enumerate(QUANTILES)})


def nonlinear(df: DataFrame) -> DataFrame:
    exprs = {f"x{k}": (lambda w, k=k: F.lead("value", k).over(w)) for k in (1, 2, 3, 4, 6)}
    d = neighbours(df, exprs, 0, 6)
    x = F.col("value")
    aggs, out = [], {}
    for lag in (1, 2, 3):
        a, b = F.col(f"x{lag}"), F.col(f"x{2 * lag}")
        aggs += [F.avg(b * a * x).alias(f"c{lag}"), F.avg(b * b * a - a * x * x).alias(f"r{lag}")]
        out[f"c3__lag_{lag}"] = F.coalesce(F.col(f"c{lag}"), F.lit(0.0))
        out[f"time_reversal_asymmetry_statistic__lag_{lag}"] = F.coalesce(F.col(f"r{lag}"), F.lit(0.0))
    return to_long(d.groupBy(*K).agg(*aggs), out)


def _sums(x, y):
    x, y = x.cast("double"), y.cast("double")
    return [F.count(y).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"),
            F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]


_ARGS = ["n", "sx", "sxx", "sy", "syy", "sxy"]


def linear_trend(df: DataFrame) -> DataFrame:
    w = df.groupBy(*K).agg(*_sums(F.col("t"), F.col("value")))
    slope, icept, r, stderr = regression(w, *[F.col(a) for a in _ARGS])
    w = w.select(*K, "n", slope.alias("slope"), icept.alias("intercept"), r.alias("rvalue"), stderr.alias("stderr"))
    dof = (F.col("n") - 2).cast("int")
    rr = F.col("rvalue")
    t = F.abs(rr) * F.sqrt(dof / F.nullif((1.0 - rr) * (1.0 + rr), F.lit(0.0)))
    p = F.when(t.isNull(), 0.0).otherwise(student_two_sided(t, dof))
    return to_long(w.withColumn("pvalue", p), {f'linear_trend__attr_"{a}"': F.col(a) for a in (
        "slope", "intercept", "rvalue", "stderr", "pvalue")})


def agg_linear_trend(df: DataFrame) -> DataFrame:
    """Regression of chunk aggregates on the chunk number (chunks of 5 and 10)."""
    cut = F.explode(F.array(F.lit(5), F.lit(10))).alias("len")
    c = df.select(*K, "t", "value", cut).groupBy(*K, "len", F.floor(F.col("t") / F.col("len")).alias("c")).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    kinds = ("min", "max", "mean", "var")
    long = c.select(*K, "len", "c", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("y")) for k in kinds])).alias("a")).select(*K, "len", "c", "a.kind", "a.y")
    w = long.groupBy(*K, "len", "kind").agg(*_sums(F.col("c"), F.col("y")))
    slope, icept, r, stderr = regression(w, *[F.col(a) for a in _ARGS])
    packed = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), e.alias("value")) for a, e in (
        ("slope", slope), ("intercept", icept), ("rvalue", r), ("stderr", stderr))])).alias("p")
    name = F.format_string('agg_linear_trend__attr_"%s"__chunk_len_%d__f_agg_"%s"', F.col("p.attr"), F.col("len"), F.col("kind"))
    return w.select(*K, "len", "kind", packed).select(*K, name.alias("feature"), F.col("p.value").alias("value"))

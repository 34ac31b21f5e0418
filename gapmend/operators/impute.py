"""Masking and imputation.

A masked table has one row per (dataset, cluster_id, series_id, miss_perc, t) with
the true ``value`` and ``hidden``; imputers see only ``x``, the value where it is
not hidden. They add ``imputed``, which equals the value on known cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.functions.columns import div, pearson, scatter
from gapmend.operators.blocks import carry, neighbours, ranked
from gapmend.operators.lowrank import impute_low_rank, impute_low_rank_all  # noqa: F401
from gapmend.operators.series import ID_BUCKET
from gapmend.session import cut_lineage

CLUSTER = ["dataset", "cluster_id"]
MASK = ["dataset", "cluster_id", "series_id", "miss_perc"]
SHARES = list(range(10, 90, 10))
GAP_START = 4
PATTERN = 5


def select_bench_series(assignment: DataFrame, strategy: str = "RDM_FROM_DATASET", n_random: int = 10,
                        least: int = 5) -> DataFrame:
    """Which series take part in the benchmark of each cluster.

    (dataset, cluster_id, series_id, role). DATASET: the cluster's first series and
    the whole data set. CLUSTER: the cluster. RDM_FROM_DATASET: at most two of the
    cluster and ``n_random`` others in scattered order, topped up from the cluster's
    end to ``least``; a cluster that stays short has role ``short``.
    """
    out = assignment.select(*CLUSTER, "series_id")
    if strategy == "CLUSTER":
        return out.withColumn("role", F.lit("cluster"))
    sizes = out.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("size"), F.min("series_id").alias("first"))
    if strategy == "DATASET":
        head = sizes.select(*CLUSTER, F.col("first").alias("series_id"), F.lit("target").alias("role"))
        rest = sizes.select(*CLUSTER).join(out.select("dataset", "series_id"), "dataset")
        return head.unionByName(rest.withColumn("role", F.lit("dataset")))
    if strategy != "RDM_FROM_DATASET":
        raise ValueError(f"unknown strategy {strategy}")
    total = sizes.groupBy("dataset").agg(F.sum("size").alias("total"))
    # pos: place in the data set's order; own: place among the series of the same cluster
    order = ranked(out, ["dataset"], [scatter("series_id"), "series_id"], scatter("series_id"), "pos")
    order = ranked(order, CLUSTER, [scatter("series_id"), "series_id"], scatter("series_id"), "own")
    # a member with fewer than n_random foreign series before it moves the cluster's cut by one
    ahead = order.where(F.col("pos") - F.col("own") < n_random).groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("ahead"))
    foreign = order.select("dataset", "series_id", "pos", F.col("cluster_id").alias("home"))
    # the first places serve every cluster; only the (at most n_random) clusters with members there look further
    near = sizes.select(*CLUSTER).join(foreign.where(F.col("pos") <= n_random), "dataset").where("home <> cluster_id")
    far = ahead.join(foreign.where(F.col("pos") > n_random), "dataset").where(
        (F.col("pos") <= F.col("ahead") + n_random) & (F.col("home") != F.col("cluster_id")))
    picked = near.select(*CLUSTER, "series_id").unionByName(far.select(*CLUSTER, "series_id")).withColumn("role", F.lit("random"))
    inside = ranked(out, CLUSTER, ["series_id"], F.floor(F.col("series_id") / ID_BUCKET).cast("bigint"), "pos")
    inside = inside.join(sizes, CLUSTER).join(total, "dataset")
    n_used = F.least(F.col("size"), F.lit(2)) + F.least(F.col("total") - F.col("size"), F.lit(n_random))
    lack = F.greatest(F.lit(least) - n_used, F.lit(0))
    enough = F.col("size") - 2 >= lack
    role = (F.when((lack > 0) & ~enough, "short").when(F.col("pos") <= 2, "cluster")
            .when(F.col("pos") > F.col("size") - lack, "tail"))
    inside = inside.withColumn("role", role).where("role IS NOT NULL").select(*CLUSTER, "series_id", "role")
    return inside.unionByName(picked)


def mask_miss_perc(df: DataFrame, steps: int | None = None, shares=SHARES, start: int = GAP_START) -> DataFrame:
    """Hide a block of each share of the first series of every cluster.

    ``df`` has cluster_id. Only the masked series are multiplied by the shares. The
    block starts ``start`` steps after the first step of the data set, whose length
    gives the block's size unless ``steps`` does.
    """
    first = df.groupBy(*CLUSTER).agg(F.min("series_id").alias("series_id"))
    span = df.groupBy("dataset").agg(F.min("t").alias("lo"), (F.max("t") - F.min("t") + 1).alias("len"))
    one = df.join(first, [*CLUSTER, "series_id"], "left_semi").join(span, "dataset")
    many = one.withColumn("miss_perc", F.explode(F.array(*[F.lit(s) for s in shares])))
    size = F.floor((F.col("len") if steps is None else F.lit(steps)) * F.col("miss_perc") / 100)
    hidden = (F.col("t") >= F.col("lo") + start) & (F.col("t") < F.col("lo") + start + size) & F.col("value").isNotNull()
    return many.select(*MASK, "t", "value", hidden.alias("hidden"))


def visible(masked: DataFrame) -> DataFrame:
    return masked.withColumn("x", F.when(~F.col("hidden"), F.col("value")))


def _level(masked: DataFrame) -> DataFrame:
    return visible(masked).groupBy(*MASK).agg(
        F.avg("x").alias("mu"), F.expr("percentile(x, 0.5)").alias("med"), F.stddev_pop("x").alias("sd"))


def fills() -> dict[str, Column]:
    """The single-series imputers over the columns that ``with_context`` adds."""
    p, n = F.col("prev"), F.col("next")
    locf = F.coalesce(p["v"], n["v"], F.lit(0.0))
    slope = (n["v"] - p["v"]) / (n["t"] - p["t"])
    line = F.when((p["t"] < n["t"]), p["v"] + slope * (F.col("t") - p["t"]))
    mu = F.coalesce("mu", F.lit(0.0))
    return {
        "mean": mu,
        "median": F.coalesce("med", F.lit(0.0)),
        "locf": locf,
        "nocb": F.coalesce(n["v"], p["v"], F.lit(0.0)),
        "linear": F.coalesce(line, locf),
        "movavg_k2": F.coalesce("ma2", mu),
        "movavg_k3": F.coalesce("ma3", mu),
    }


def with_context(masked: DataFrame) -> DataFrame:
    """Add nearest known points, centred means of known cells and series levels."""
    base = carry(visible(masked), "x", MASK, extra={
        "ma2": lambda w: F.avg("x").over(w.rowsBetween(-5, 5)),
        "ma3": lambda w: F.avg("x").over(w.rowsBetween(-10, 10))}, before=10, after=10)
    return base.join(_level(masked), MASK)


def impute(masked: DataFrame, algorithm: str) -> DataFrame:
    """One single-series imputer; touches only the context that it needs."""
    if algorithm in ("locf", "nocb", "linear"):
        base = carry(visible(masked), "x", MASK)
        base = base.withColumns({"mu": F.lit(None).cast("double"), "med": F.lit(None).cast("double")})
    elif algorithm.startswith("movavg"):
        half = {"movavg_k2": 5, "movavg_k3": 10}[algorithm]
        name = "ma" + algorithm[-1]
        base = neighbours(visible(masked), {name: lambda w: F.avg("x").over(w.rowsBetween(-half, half))},
                          half, half, MASK).join(_level(masked), MASK)
    else:
        base = visible(masked).join(_level(masked), MASK)
    return base.select(*masked.columns, F.lit(algorithm).alias("algorithm"),
                       F.coalesce("x", fills()[algorithm]).alias("imputed"))


def impute_simple(masked: DataFrame, algorithms: list[str] | None = None) -> DataFrame:
    """All single-series imputers in one pass over the masked table."""
    chosen = {k: v for k, v in fills().items() if algorithms is None or k in algorithms}
    base = with_context(masked)
    packed = F.explode(F.array(*[
        F.struct(F.lit(k).alias("algorithm"), F.coalesce("x", v).alias("imputed")) for k, v in chosen.items()]))
    return base.select(*masked.columns, packed.alias("r")).select(*masked.columns, "r.algorithm", "r.imputed")


# --- imputers that use the other series of the cluster ----------------------------

def _sibling_fit(masked: DataFrame, cells: DataFrame) -> DataFrame:
    """Power sums of the known target cells against every other series of the cluster.

    A cluster is bounded (``explode_large_clusters``), so one masked series meets
    at most 14 others.
    """
    sib = cells.select(*CLUSTER, F.col("series_id").alias("sib"), "t", F.col("value").alias("y"))
    both = visible(masked).where("x IS NOT NULL").join(sib, [*CLUSTER, "t"]).where(
        "sib <> series_id AND y IS NOT NULL")
    x, y = F.col("y"), F.col("x")
    s = both.groupBy(*MASK, "sib").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    c = lambda k: F.col(k)
    s = s.withColumn("r", pearson(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy"))).where("r IS NOT NULL")
    slope = (c("n") * c("sxy") - c("sx") * c("sy")) / (c("n") * c("sxx") - c("sx") * c("sx"))
    s = s.withColumn("slope", slope).withColumn("icept", (c("sy") - c("slope") * c("sx")) / c("n"))
    var = c("sxx") / c("n") - (c("sx") / c("n")) * (c("sx") / c("n"))
    return s.select(*MASK, "sib", "r", "slope", "icept", (c("sx") / c("n")).alias("smu"), F.sqrt(var).alias("ssd"))


def _best_siblings(fit: DataFrame, k: int) -> DataFrame:
    entry = F.struct((-F.round(F.abs("r"), 9)).alias("o"), "sib", "r", "slope", "icept", "smu", "ssd")
    best = fit.groupBy(*MASK).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
    return best.select(*MASK, F.explode("best").alias("b")).select(*MASK, "b.sib", "b.r", "b.slope", "b.icept", "b.smu", "b.ssd")


def impute_regression(masked: DataFrame, cells: DataFrame) -> DataFrame:
    """Linear regression on the most correlated series of the cluster."""
    best = _best_siblings(_sibling_fit(masked, cells), 1)
    sib = cells.select(*CLUSTER, F.col("series_id").alias("sib"), "t", F.col("value").alias("y"))
    base = visible(masked).join(_level(masked), MASK).join(best, MASK, "left").join(sib, [*CLUSTER, "sib", "t"], "left")
    guess = F.coalesce(F.col("icept") + F.col("slope") * F.col("y"), F.col("mu"), F.lit(0.0))
    return base.select(*masked.columns, F.lit("regression").alias("algorithm"), F.coalesce("x", guess).alias("imputed"))


def impute_knn_series(masked: DataFrame, cells: DataFrame, k: int = 3) -> DataFrame:
    """Correlation-weighted mean of the z-scores of the k most correlated series."""
    best = _best_siblings(_sibling_fit(masked, cells), k)
    sib = cells.where("value IS NOT NULL").select(*CLUSTER, F.col("series_id").alias("sib"), "t", F.col("value").alias("y"))
    # a mask key has at most k * steps rows here
    z = best.join(sib, [*CLUSTER, "sib"]).groupBy(*MASK, "t").agg(
        F.sum(F.col("r") * (F.col("y") - F.col("smu")) / F.col("ssd")).alias("num"), F.sum(F.abs("r")).alias("den"))
    base = visible(masked).join(_level(masked), MASK).join(z, [*MASK, "t"], "left")
    guess = F.coalesce(F.col("mu") + F.col("sd") * div("num", "den"), F.col("mu"), F.lit(0.0))
    return base.select(*masked.columns, F.lit("knn_series").alias("algorithm"), F.coalesce("x", guess).alias("imputed"))


def _pattern_guess(ref: np.ndarray, x: np.ndarray, fallback: float, k: int) -> np.ndarray:
    """Mean of the k known values whose preceding reference pattern is nearest."""
    out = np.where(np.isnan(x), fallback, x)
    if len(x) < PATTERN or np.isnan(ref).all():
        return out
    win = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(ref), PATTERN)
    ends = np.arange(PATTERN - 1, len(x))
    known = ends[~np.isnan(x[ends])]
    if len(known) == 0:
        return out
    for t in ends[np.isnan(x[ends])]:
        dist = np.round(((win[known - PATTERN + 1] - win[t - PATTERN + 1]) ** 2).sum(axis=1), 6)
        out[t] = x[known[np.lexsort((known, dist))[:k]]].mean()
    return out


def impute_pattern_knn(masked: DataFrame, cells: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the k known values whose preceding pattern in the most correlated
    series of the cluster is most similar. One row (two arrays) is one task unit."""
    best = _best_siblings(_sibling_fit(masked, cells), 1).select(*MASK, "sib")
    cell = F.struct("t", "x", "hidden", "value")
    tgt = visible(masked).groupBy(*MASK).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    ref = cells.groupBy(*CLUSTER, F.col("series_id").alias("sib")).agg(
        F.array_sort(F.collect_list(F.struct("t", F.coalesce("value", F.lit(0.0)).alias("y")))).alias("s"))
    # flat arrays: structs would become one Python object per cell, and a batch of rows is many cells
    part = lambda name: F.transform("c", lambda v: v[name]).alias(name)
    rows = tgt.join(_level(masked).select(*MASK, "mu"), MASK).join(best, MASK, "left").join(
        ref, [*CLUSTER, "sib"], "left").select(
        *MASK, "mu", part("t"), part("x"), part("hidden"), part("value"), F.transform("s", lambda v: v["y"]).alias("y"))

    def run(batches):
        for pdf in batches:
            res = []
            for x, y, mu in zip(pdf["x"], pdf["y"], pdf["mu"]):
                xa = np.array(x, dtype=float)
                ya = np.full(len(xa), np.nan) if y is None else np.array(y, dtype=float)
                res.append(_pattern_guess(ya, xa, 0.0 if pd.isna(mu) else mu, k))
            yield pdf[[*MASK, "t", "hidden", "value"]].assign(g=res)

    schema = ("dataset string, cluster_id bigint, series_id bigint, miss_perc int, "
              "t array<bigint>, hidden array<boolean>, value array<double>, g array<double>")
    out = rows.mapInPandas(run, schema)
    return out.select(*MASK, F.explode(F.arrays_zip("t", "value", "hidden", "g")).alias("z")).select(
        *MASK, "z.t", "z.value", "z.hidden", F.lit("pattern_knn").alias("algorithm"), F.col("z.g").alias("imputed"))


def impute_als(masked: DataFrame, cells: DataFrame, rank: int = 4, iterations: int = 8, seed: int = 7) -> DataFrame:
    """Non-negative matrix factorisation of the masked and the complete series of a data set.

    Values are scaled to [0, 1] per series before. Each (data set, share) has rows and
    columns of its own in the factorised matrix, so its factors see no cell that its
    share hides and nothing of other data sets; a series that is masked in any cluster
    takes part only as masked. Ids beyond the integers that ALS knows are an error.
    """
    block = ["dataset", "miss_perc"]
    first = masked.select("dataset", "series_id").distinct()
    whole = cells.join(first, ["dataset", "series_id"], "left_anti").where("value IS NOT NULL").groupBy("dataset", "series_id", "t").agg(
        F.max("value").alias("x"))
    # a complete series belongs to no cluster here, and to every share
    others = whole.join(masked.select(*block).distinct(), "dataset").select(
        "dataset", F.lit(-1).cast("bigint").alias("cluster_id"), "series_id", "miss_perc", "t", "x")
    rows = visible(masked).where("x IS NOT NULL").select(*MASK, "t", "x").unionByName(others)
    span = rows.groupBy(*MASK).agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("width"),
                                   F.min("t").alias("t0"), F.max("t").alias("t1"))
    span = ranked(span, block, ["series_id", "cluster_id"], F.floor(F.col("series_id") / ID_BUCKET).cast("bigint"), "pos")
    span = cut_lineage(span)
    # ids: the place in the block plus what earlier blocks hold; one row per block
    sizes = span.groupBy(*block).agg(F.max("pos").alias("users"), F.min("t0").alias("first_t"), (F.max("t1") - F.min("t0") + 1).alias("items"))
    earlier = W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*block, "first_t", "items", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("users", "items")])
    ids = span.join(sizes, block).withColumn("user", (F.col("pos") + F.col("users_before")).cast("int")).select(
        *MASK, "lo", "width", "user", "first_t", "items", "items_before")
    place = F.col("t") - F.col("first_t")
    # a step outside of all known ones has no factors, so any id that is not in use will do
    item = F.when((place >= 0) & (place < F.col("items")), place + F.col("items_before")).otherwise(-1).cast("int")
    train = rows.join(ids, MASK).select(
        "user", item.alias("item"), F.coalesce(div(F.col("x") - F.col("lo"), "width"), F.lit(0.0)).alias("rating"))
    model = ALS(userCol="user", itemCol="item", ratingCol="rating", rank=rank, maxIter=iterations, nonnegative=True,
                regParam=0.05, seed=seed, coldStartStrategy="nan").fit(train)
    scored = model.transform(masked.join(ids, MASK, "left").withColumn("item", F.coalesce(item, F.lit(-1))).withColumn(
        "user", F.coalesce("user", F.lit(-1))))
    guess = F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)) * F.coalesce("width", F.lit(0.0)) + F.coalesce("lo", F.lit(0.0))
    return scored.select(*masked.columns, F.lit("als").alias("algorithm"), F.when(
        ~F.col("hidden") & F.col("value").isNotNull(), F.col("value")).otherwise(guess).alias("imputed"))

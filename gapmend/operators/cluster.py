"""Clustering: k-Shape, k-means, parameter-free refinement, merging, constraints.

Loops are level-synchronous: one round treats all data sets and all open clusters in
one job, and its small state is checkpointed.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.functions.columns import SERIES, div, pearson
from gapmend.operators.blocks import ranked
from gapmend.operators.correlate import BATCH, BLOCK, Spectra, block_pairs, half_pairs, key_schema, mean_ncc, mean_ncc_arrays, pair_table, vector_sums
from gapmend.operators.series import ID_BUCKET, explode_large_clusters, global_cluster_id, series_to_array, znormalize
from gapmend.session import cut_lineage
from gapmend.sources.tables import dataset_profile

CLUSTER = ["dataset", "cluster_id"]
RUN = ["dataset", "run_k", "run_seed"]
SIMILAR, FAR = 0.55, 0.4
MIN_SERIES, MAX_SERIES = 5, 15
# a bound for runs whose labels never settle, and how far a centroid of length 1 may still move at rest
KSHAPE_ROUNDS, REST = 100, 1e-3
# series up to this length have their outer products summed
GRAM_STEPS = 512
# values of the series that one task holds
BLOCK_VALUES = 1 << 23
# pairs of series and centroids that one task compares in a round, and those it holds at a time
BLOCK_TABLE, PAIR_TABLE = 1 << 31, 1 << 22
# fixed values: complexity bounds and number of cluster counts to try
GRID_TESTS = [(50_000, 20), (100_000, 16), (150_000, 13), (200_000, 9), (float("inf"), 6)]
GRID_RUNS = {"small": 6, "medium": 4, "large": 3}
FINAL_RUNS = {"small": 50, "medium": 25, "large": 15}
# clusters of a data set that merge inside one task
MERGE_CLUSTERS = 2048
# pairs that are compared in the time that a group of its own costs
GROUP_PAIRS = 5000
# tasks that the runs of a data set are dealt to, and partitions that all of them are
COPIES, TASKS = 16, 512
# how often a run with a cluster of a lone series is clustered again before it scores 0
MAX_RETRIES = 5


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else v


def z_arrays(df: DataFrame) -> DataFrame:
    """(dataset, series_id, vals): z-normalised, constant series become zeros."""
    z = znormalize(df.select(*SERIES, "t", "value"))
    return series_to_array(z.withColumn("value", F.coalesce("value", F.lit(0.0))))


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column ids, so that a table can meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _aligned(rows: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Every row moved by its shift, zeros where nothing lies, centred."""
    n, m = rows.shape
    wide = np.zeros((n, 3 * m))
    wide[:, m:2 * m] = rows
    y = np.lib.stride_tricks.sliding_window_view(wide, m, axis=1)[np.arange(n), m - shifts]
    return y - y.mean(axis=1, keepdims=True)


def _shifts(series: Spectra, cents: Spectra) -> np.ndarray:
    """Best correlation over all shifts of every series (row) and centroid (column), in single precision."""
    return series.best(cents, np.float32)


def _settled(series: Spectra, cents: Spectra, top: np.ndarray, ids: np.ndarray, at: np.ndarray, old: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best correlation to 9 digits, its centroid (an index) and shift of the series ``at``; ties go to the first centroid.

    ``top`` has a row for each of them and a column for each centroid ``ids``. Only the centroids that single precision cannot
    tell from the best are compared exactly. ``old`` has a further value, centroid and shift of each series.
    """
    best = top.max(axis=1) if old is None else np.maximum(top.max(axis=1), old[0].astype(np.float32))
    # what rounding may change in a product of vectors of length 1, on both sides
    near = top >= (best - 2 * (series.m + 2) * np.finfo(np.float32).eps)[:, None]
    # a zero series is as far from one as from another: the first serves for all
    near[np.ix_(~series.units[at].any(axis=1), ids != ids.min())] = False
    row, col = np.nonzero(near)
    value, shift = series.pairs(at[row], cents, ids[col])
    value, which = value.round(9), ids[col]
    if old is not None:
        row, value, which, shift = np.r_[row, np.arange(len(at))], np.r_[value, old[0]], np.r_[which, old[1]], np.r_[shift, old[2]]
    order = np.lexsort((which, -value, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return value[first], which[first], shift[first]


def _nearest(series: Spectra, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best correlation over all shifts, index of that centroid and shift, of every series; ties go to the first centroid."""
    n, c = len(series.rows), Spectra(cents)
    best, which, shift = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # the table of all series and centroids may be large: some series at a time
    series.as_kind(np.float32)
    step = max(1, PAIR_TABLE // len(cents))
    for i in range(0, n, step):
        at = np.arange(i, min(i + step, n))
        best[at], which[at], shift[at] = _settled(series, c, _shifts(series.part(at), c), np.arange(len(cents)), at)
    return best, which, shift


def _part(members: np.ndarray, old: np.ndarray) -> np.ndarray:
    """What aligned members add to their next centroid."""
    return (members.T @ members).ravel() if len(old) <= GRAM_STEPS else members.T @ (members @ old)


def _centroid(part: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The next centroid from the sum of all parts."""
    if len(part) != len(old):
        part = np.linalg.eigh(part.reshape(len(old), -1))[1][:, -1]
        part = part if part @ old >= 0 else -part
    return _unit(part)


def _next_centroid(members: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The next centroid from all aligned members; that of fewer members than steps comes from their products with each other."""
    n, m = members.shape
    if n < m <= GRAM_STEPS:
        size, vec = np.linalg.eigh(members @ members.T)
        if size[-1] > 1e-9:
            part = members.T @ vec[:, -1]
            return _unit(part if part @ old >= 0 else -part)
    return _centroid(_part(members, old), old)


def _far(new: np.ndarray, old: np.ndarray) -> bool:
    return float(((new - old) ** 2).sum()) > REST ** 2


def _kshape_block(sid: np.ndarray, rows: np.ndarray, k: int, seed: int, rounds: int, series: Spectra | None = None) -> tuple[np.ndarray, bool]:
    """Labels of a group inside one task, and whether they have settled.

    A cluster with the members and shifts of the round before has the same centroid again, up to ``GRAM_STEPS`` steps; it is not
    computed anew. Series are compared with the centroids that have changed; only those that lose their own to a change meet the others
    again. No table of series and centroids is kept, so memory follows the series.
    """
    order = np.lexsort((sid, (sid % 10007 * 7919 + 104729 + 31 * seed) % 10007))
    series = Spectra(rows) if series is None else series
    series.as_kind(np.float32)
    n = len(rows)
    vec, alive = rows[order[:k]], np.ones(min(k, n), bool)
    value, which, shift = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
    moved = True

    def compare(changed: np.ndarray) -> None:
        """Bring value, which and shift up to date, when the centroids ``changed`` have."""
        cents, rest = Spectra(vec), np.flatnonzero(alive)
        rest = rest[~np.isin(rest, changed)]
        lost = ~np.isin(which, rest)
        step = max(1, PAIR_TABLE // max(len(changed), len(rest), 1))
        new, same = cents.part(changed), cents.part(rest)
        for i in range(0, n, step):
            at = np.arange(i, min(i + step, n))
            top, gone = _shifts(series.part(at), new), lost[at]
            if gone.any():
                now, full, ids = at[gone], top[gone], changed
                if len(rest):
                    full, ids = np.hstack([full, _shifts(series.part(now), same)]), np.r_[changed, rest]
                value[now], which[now], shift[now] = _settled(series, cents, full, ids, now)
            if not gone.all():
                now = at[~gone]
                value[now], which[now], shift[now] = _settled(series, cents, top[~gone], changed, now, (value[now], which[now], shift[now]))

    compare(np.arange(len(vec)))
    labels = turn = None
    for _ in range(rounds):
        now, lag = which.copy(), shift.copy()
        stay = np.unique(now)
        if labels is None or rows.shape[1] > GRAM_STEPS:
            other = stay
        else:
            new = (now != labels) | (lag != turn)
            other = stay[np.isin(stay, np.r_[now[new], labels[new]])]
        moved = labels is None or bool((now != labels).any())
        by = np.argsort(now, kind="stable")
        begin, end = np.searchsorted(now[by], other), np.searchsorted(now[by], other, "right")
        fresh = []
        for j, b, e in zip(other, begin, end):
            mine = by[b:e]
            cent = _next_centroid(_aligned(series.rows[mine], lag[mine]), vec[j])
            moved |= _far(cent, vec[j])
            if not np.array_equal(cent, vec[j]):
                vec[j] = cent
                fresh.append(j)
        labels, turn = now, lag
        # a centroid without members goes
        alive[:] = False
        alive[stay] = True
        if fresh:
            compare(np.array(fresh))
        if not moved:
            break
    return which, not moved


def kshape(arrays: DataFrame, keys: list[str], rounds: int = KSHAPE_ROUNDS, flag: bool = False) -> DataFrame:
    """k-Shape per group: (keys, series_id, cluster_id), and with ``flag`` also converged.

    ``arrays``: keys, series_id, vals, k, seed. Series go to the centroid with the best cross-correlation over
    all shifts; the centroid of a cluster is the leading eigenvector of the summed outer products of its aligned
    members. Series of more than ``GRAM_STEPS`` steps need no matrix over time: their centroids move by one step of the power
    iteration a round. A group rests when no label changes and no centroid moves by ``REST``, so that labels
    and eigenvectors have both settled. A group still moving after ``rounds`` rounds is not converged.

    A group that is one block, of at most ``BLOCK_VALUES`` values and ``BLOCK_TABLE`` pairs of series and centroids, settles inside one task. Larger groups are laid out
    in blocks once. A task sees one block and the centroids of its group, and returns one sum, one count and
    one checksum of the members per cluster; only the centroids pass from round to round. A group with more than ``BLOCK``
    centroids compares in blocks of both first. Resting groups take no part; labels are read off once, at the end.
    """
    rows = arrays.select(*keys, "series_id", "vals", "k", "seed")
    head = key_schema(arrays, keys)
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.max(F.size("vals")) / BLOCK_VALUES)).cast("bigint").alias("nl"),
                                    F.ceil(F.max("k") / BLOCK).cast("bigint").alias("nr"), (F.count(F.lit(1)) * F.max("k") <= BLOCK_TABLE).alias("fits"))
    data = cut_lineage(rows.join(sizes, keys).withColumn("lb", F.pmod(F.hash("series_id"), F.col("nl"))).repartition(*keys, "lb"))
    tail = "series_id bigint, cluster_id bigint, converged boolean"

    def settle(key, a: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("series_id")
        labels, done = _kshape_block(a["series_id"].to_numpy(), np.stack(a["vals"].to_numpy()).astype(float), int(a["k"].iloc[0]), int(a["seed"].iloc[0]), rounds)
        out = pd.DataFrame({"series_id": a["series_id"].to_numpy(), "cluster_id": labels, "converged": done})
        for name, v in zip(keys, key):
            out[name] = v
        return out[[*keys, "series_id", "cluster_id", "converged"]]

    out = data.where("nl = 1 AND fits").groupBy(*keys).applyInPandas(settle, f"{head}, {tail}")
    large = data.where("nl > 1 OR NOT fits")
    if not large.isEmpty():
        out = out.unionByName(_kshape_blocks(large, keys, head, rounds))
    out = cut_lineage(out)
    return out if flag else out.drop("converged")


def _kshape_blocks(data: DataFrame, keys: list[str], head: str, rounds: int) -> DataFrame:
    """k-Shape of groups of several blocks: (keys, series_id, cluster_id, converged)."""
    # the first k members in the scatter order of the seed are the starting centroids
    order = F.pmod(F.pmod("series_id", F.lit(10007)) * 7919 + 104729 + 31 * F.col("seed"), F.lit(10007))
    first = ranked(data, keys, [order, "series_id"], order).where(F.col("rn") <= F.col("k"))
    cents = cut_lineage(first.select(*keys, (F.col("rn") - 1).alias("bid"), F.col("vals").alias("vec"), F.lit(-1).cast("bigint").alias("n"),
                                     F.lit(0).cast("bigint").alias("mark"), F.lit(True).alias("moved")))
    blocks = cut_lineage(data.select(*keys, "lb", "nr").distinct())
    wide = blocks.agg(F.max("nr")).first()[0] > 1

    def spread(c: DataFrame) -> DataFrame:
        """Every centroid of a group beside every block of its series."""
        return _fresh(c.join(blocks, keys))

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "series_id", "ncc", "cluster_id", "shift"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)
        b = b.sort_values("bid")
        ncc, which, shift = _nearest(Spectra(a["vals"].to_numpy()), np.stack(b["vec"].to_numpy()))
        out = pd.DataFrame({"series_id": a["series_id"].to_numpy(), "ncc": ncc, "cluster_id": b["bid"].to_numpy()[which], "shift": shift})
        for k, v in zip(keys, key):
            out[k] = v
        return out[cols]

    def best(c: DataFrame) -> DataFrame:
        """(keys, series_id, cluster_id, shift) by the centroids ``c``."""
        kinds = f"{head}, series_id bigint, ncc double, cluster_id bigint, shift bigint"
        if not wide:
            return data.groupBy(*keys, "lb").cogroup(spread(c).groupBy(*keys, "lb")).applyInPandas(compare, kinds).drop("ncc")
        at = spread(c).withColumn("rb", F.pmod(F.hash("bid"), F.col("nr")))
        many = data.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nr") - 1)))
        found = many.groupBy(*keys, "lb", "rb").cogroup(at.groupBy(*keys, "lb", "rb")).applyInPandas(compare, kinds)
        top = F.max_by(F.struct("cluster_id", "shift"), F.struct("ncc", (-F.col("cluster_id")).alias("c")))
        return found.groupBy(*keys, "series_id").agg(top.alias("b")).select(*keys, "series_id", "b.*")

    def push(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The block's part of the next centroids, beside the present ones."""
        b = b.sort_values("bid")
        ids = b["bid"].to_numpy()
        part, n, mark = [np.zeros(0)] * len(ids), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        if len(a) and len(b):
            vec, series = np.stack(b["vec"].to_numpy()), Spectra(a["vals"].to_numpy())
            if wide:
                which, shift = np.searchsorted(ids, a["cluster_id"].to_numpy()), a["shift"].to_numpy()
            else:
                _, which, shift = _nearest(series, vec)
            y = _aligned(series.rows, shift)
            sign = (a["series_id"].to_numpy() * 0x9E3779B1 + 12345) % 0x7FFFFFFF
            for j in np.unique(which):
                mine = which == j
                part[j], n[j], mark[j] = _part(y[mine], vec[j]), mine.sum(), sign[mine].sum()
        out = pd.DataFrame({"bid": ids, "part": part, "n": n, "mark": mark, "vec": b["vec"].to_numpy(), "n0": b["n"].to_numpy(), "mark0": b["mark"].to_numpy(), "live": bool(len(a))})
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, *out.columns[:8]]]

    def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "bid", "vec", "n", "mark", "moved"]
        first = pdf.iloc[0]
        if not pdf["live"].any():
            return pd.DataFrame([[*key, first["vec"], first["n0"], first["mark0"], False]], columns=cols)
        n, mark, old = int(pdf["n"].sum()), int(pdf["mark"].sum()), np.asarray(first["vec"], float)
        if not n:  # a centroid without members goes; its members have changed the counts of others
            return pd.DataFrame(columns=cols)
        vec = _centroid(np.sum([p for p in pdf["part"] if len(p)], axis=0), old)
        return pd.DataFrame([[*key, vec, n, mark, n != first["n0"] or mark != first["mark0"] or _far(vec, old)]], columns=cols)

    for _ in range(rounds):
        live = _fresh(cents.where("moved").select(*keys).distinct())
        rest = data.join(live, keys, "left_semi")  # resting groups send no series
        if wide:
            members = best(cents.join(live, keys, "left_semi")).join(rest, [*keys, "series_id"])
            hit = _fresh(members.select(*keys, "lb", F.col("cluster_id").alias("bid")).distinct())
            # a block needs the centroids of its members; one block speaks for those without
            near = spread(cents).join(hit.withColumn("hit", F.lit(True)), [*keys, "lb", "bid"], "left").where("hit OR lb = 0").drop("hit")
            parts = members.groupBy(*keys, "lb").cogroup(near.groupBy(*keys, "lb"))
        else:
            parts = rest.groupBy(*keys, "lb").cogroup(spread(cents).groupBy(*keys, "lb"))
        parts = parts.applyInPandas(push, f"{head}, bid bigint, part array<double>, n bigint, mark bigint, vec array<double>, n0 bigint, mark0 bigint, live boolean")
        cents = cut_lineage(parts.groupBy(*keys, "bid").applyInPandas(total, f"{head}, bid bigint, vec array<double>, n bigint, mark bigint, moved boolean"))
        if cents.where("moved").isEmpty():
            break
    return best(cents).select(*keys, "series_id", "cluster_id").join(cents.groupBy(*keys).agg((~F.max("moved")).alias("converged")), keys)


def kmeans_series(df: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k-means on the value vectors of one data set."""
    rows = series_to_array(df).withColumn("v", array_to_vector("vals"))
    model = KMeans(k=k, featuresCol="v", seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select(*SERIES, F.col("prediction").cast("bigint").alias("cluster_id"))


def _named_by_first(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Rename clusters to their smallest series id, which is unique in a data set."""
    names = labels.groupBy(*keys, "cluster_id").agg(F.min("series_id").alias("name"))
    return labels.join(names, [*keys, "cluster_id"]).select("dataset", "series_id", F.col("name").alias("cluster_id"))


def incremental_cluster(df: DataFrame, accept: float = 0.75, accept_all: float = 0.9, k_share: float = 0.2,
                        patience: int = 5, max_rounds: int | None = None, split_rounds: int = KSHAPE_ROUNDS, start: DataFrame | None = None) -> DataFrame:
    """Refine clusters until each is correlated enough, without a given k.

    Every round scores all open clusters at once. A cluster is accepted when it has one
    member or a mean correlation of at least ``accept`` (``accept_all`` in the first
    round); two members are separated; others are split in max(2, n * k_share) parts.
    Clusters that keep failing get more parts and, after 15 * patience failures, an
    split in every other member, which ends the loop. The failure count belongs to a lineage of clusters.
    ``start`` has clusters to begin with, else each data set is one. Clusters still open after a given
    ``max_rounds`` are not converged.

    The series are read and normalised once; a round sums the vectors of open clusters only, and one table holds the state
    of all series.
    """
    z = cut_lineage(z_arrays(df).withColumn("constant", ~F.exists("vals", lambda x: x != 0)))
    one = z.groupBy("dataset").agg(F.min("series_id").alias("cluster_id")).join(z.select(*SERIES), "dataset")
    state = cut_lineage((one if start is None else start).select(*SERIES, "cluster_id", F.lit(0).alias("fails"), F.lit(True).alias("open")))
    for rnd in count() if max_rounds is None else range(max_rounds):
        now = z.join(state.where("open"), SERIES)
        flat = now.groupBy(*CLUSTER).agg(F.max("constant").alias("flat"))
        size = F.col("n").cast("double")
        m = F.size("sums")
        # with z-vectors of length m the mean over pairs follows from the length of their sum; a constant member leaves it undefined
        corr = F.when(size == 1, 1.0).when(F.col("flat"), 0.0).otherwise((F.aggregate("sums", F.lit(0.0), lambda s, x: s + x * x) / m - size) / (size * (size - 1)))
        score = vector_sums(now, CLUSTER).join(flat, CLUSTER).select(*CLUSTER, F.col("n").alias("n_series"), corr.alias("score"))
        need = accept_all if rnd == 0 else accept
        verdict = F.when((F.col("n_series") == 1) | (F.col("score") >= need), "accept").when(F.col("n_series") == 2, "single").otherwise("split")
        judged = cut_lineage(state.where("open").join(score.select(*CLUSTER, "n_series", verdict.alias("verdict")), CLUSTER))
        rest = judged.where("verdict = 'split'").withColumn("fails", F.col("fails") + 1)
        done = judged.where("verdict <> 'split'").select(*SERIES, F.when(F.col("verdict") == "single", F.col("series_id")).otherwise(
            F.col("cluster_id")).alias("cluster_id"), "fails", F.lit(False).alias("open"))
        done = state.where("NOT open").unionByName(done)
        if rest.isEmpty():
            state = done
            break
        k = F.greatest(F.lit(2), F.floor(F.col("n_series") * k_share)).cast("bigint")
        boost = F.when(F.col("fails") >= patience, k + F.floor(F.col("fails") / (patience - 1)) * k).otherwise(k)
        rest = rest.withColumn("k", F.least(boost, F.col("n_series")).cast("bigint"))
        stuck = rest.where(F.col("fails") >= 15 * patience).select("dataset", "cluster_id", "series_id", "fails")
        # even and odd members of a stuck cluster part; by position, as its ids may all be even
        halves = ranked(stuck.withColumnRenamed("cluster_id", "parent"), ["dataset", "parent"], ["series_id"], F.floor(F.col("series_id") / ID_BUCKET).cast("bigint"), "pos").select(
            "dataset", "parent", "series_id", F.pmod("pos", F.lit(2)).cast("bigint").alias("cluster_id"))
        arr = rest.where(F.col("fails") < 15 * patience).join(z, SERIES).select(
            "dataset", F.col("cluster_id").alias("parent"), "series_id", "vals", "k", F.lit(rnd).alias("seed"))
        parts = kshape(arr, ["dataset", "parent"], split_rounds).unionByName(halves)
        named = _named_by_first(parts, ["dataset", "parent"]).join(rest.select(*SERIES, "fails"), SERIES)
        state = cut_lineage(done.unionByName(named.select(*SERIES, "cluster_id", "fails", F.lit(True).alias("open"))).coalesce(_parts(df)))
    # out of rounds: what is open stays as it is
    return state.select(*SERIES, "cluster_id", (~F.col("open")).alias("converged"))


def _parts(df: DataFrame) -> int:
    """As many partitions as a shuffle has: unions of round-based tables must not add up theirs."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- merging ------------------------------------------------------------------------

def cluster_stats(df: DataFrame) -> DataFrame:
    """Per cluster: n, phi (mean correlation), s (sum of z-vectors), the centroid c, and ok: no member is constant."""
    raw = df.groupBy(*CLUSTER, "t").agg(F.avg("value").alias("c"))
    z = znormalize(df)
    zs = z.groupBy(*CLUSTER, "t").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.count("value").alias("ok"))
    both = zs.join(raw, [*CLUSTER, "t"])
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("t", F.coalesce(c, F.lit(0.0)).alias("x")))), lambda v: v["x"])
    out = both.groupBy(*CLUSTER).agg(F.max("n").alias("n"), F.min("ok").alias("ok"), F.count(F.lit(1)).alias("m"),
                                     F.sum(F.col("s") * F.col("s")).alias("ss"), pack("s").alias("s"), pack("c").alias("c"))
    n = F.col("n").cast("double")
    phi = F.when(F.col("n") == 1, 1.0).when(F.col("ok") == F.col("n"), (F.col("ss") / F.col("m") - n) / (n * (n - 1)))
    out = out.withColumn("phi", phi)
    tot = out.groupBy("dataset").agg(F.sum("n").alias("n_all"))
    return out.join(tot, "dataset").select(*CLUSTER, "n", "n_all", (F.col("ok") == F.col("n")).alias("ok"), "phi", "s", "c")


PAIR = ("dataset string, a bigint, b bigint, similarity double, phi_union double, gain double, phi_a double, phi_b double, n_a bigint, n_b bigint")


def similar_clusters(stats: DataFrame, threshold: float = SIMILAR, fresh: DataFrame | None = None) -> DataFrame:
    """Pairs of clusters of a data set whose centroids correlate at least ``threshold``.

    (dataset, a, b, similarity, phi_union, gain, phi_a, phi_b, n_a, n_b), a < b, with
    gain = (phi(a u b) - phi_a phi_b / N) / 2N. Pairs are tested between blocks of
    clusters; only those that pass are emitted. With ``fresh`` (dataset, cluster_id) only pairs with such a cluster are tested.
    """
    cols = [x.split()[0] for x in PAIR.split(", ")]
    mark = stats.withColumn("fresh", F.lit(True)) if fresh is None else stats.join(
        _fresh(fresh.select(*CLUSTER)).withColumn("fresh", F.lit(True)), CLUSTER, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    side = mark.select("dataset", F.col("cluster_id").alias("bid"), "n", "n_all", F.coalesce("phi", F.lit(float("nan"))).alias("phi"), "s", "c", "fresh")

    def test(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)

        def rows(p):
            c = np.stack(p["c"].to_numpy()).astype(float)
            c = c - c.mean(axis=1, keepdims=True)
            size = np.linalg.norm(c, axis=1, keepdims=True)
            return np.where(size > 1e-9, c / np.where(size > 1e-9, size, 1), np.nan), np.stack(p["s"].to_numpy()).astype(float)
        ca, sa = rows(a)
        cb, sb = rows(b)
        sim = np.round(ca @ cb.T, 9)
        ia, ib, other = a["bid"].to_numpy()[:, None], b["bid"].to_numpy()[None, :], b["fresh"].to_numpy()[None, :]
        # two fresh clusters meet from both sides: one of them counts
        keep = (sim >= threshold) & np.where(other, ia < ib, ia != ib)
        i, j = np.nonzero(keep)
        na, nb = a["n"].to_numpy()[i], b["n"].to_numpy()[j]
        n, m = na + nb, sa.shape[1]
        pa, pb, total = a["phi"].to_numpy()[i], b["phi"].to_numpy()[j], a["n_all"].to_numpy()[i]
        union = ((((sa[i] + sb[j]) ** 2).sum(axis=1)) / m - n) / (n * (n - 1))
        gain = (union - pa * pb / total) / (2 * total)
        one, two = a["bid"].to_numpy()[i], b["bid"].to_numpy()[j]
        turn = one > two
        swap = lambda x, y: (np.where(turn, y, x), np.where(turn, x, y))
        (one, two), (pa, pb), (na, nb) = swap(one, two), swap(pa, pb), swap(na, nb)
        return pd.DataFrame({"dataset": key[0], "a": one, "b": two, "similarity": sim[i, j], "phi_union": union, "gain": gain, "phi_a": pa, "phi_b": pb, "n_a": na, "n_b": nb})[cols]

    return block_pairs(side.where("fresh"), side, ["dataset"], test, PAIR).where("NOT isnan(gain)")


def far_from_centroid(df: DataFrame, threshold: float = FAR) -> DataFrame:
    """Series of clusters with more than one member that correlate below ``threshold``
    with their centroid (a constant series counts as 0)."""
    cen = df.groupBy(*CLUSTER, "t").agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("members"))
    j = df.join(cen, [*CLUSTER, "t"]).where("members > 1")
    x, y = F.col("value"), F.col("y")
    s = j.groupBy(*CLUSTER, "series_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                                             F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    c = F.col
    r = F.coalesce(pearson(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy")), F.lit(0.0))
    return s.select(*CLUSTER, "series_id", r.alias("corr")).where(F.col("corr") < threshold)


def _matched(edges: DataFrame, better: str) -> DataFrame:
    """Disjoint merges (dataset, src, dst): pairs that are each other's best choice."""
    both = edges.select("dataset", F.col("a").alias("x"), F.col("b").alias("y"), better).unionByName(
        edges.select("dataset", F.col("b").alias("x"), F.col("a").alias("y"), better))
    pick = both.groupBy("dataset", "x").agg(F.max_by("y", F.struct(F.round(better, 12), (-F.col("y")).alias("o"))).alias("y"))
    back = pick.select("dataset", F.col("y").alias("x"), F.col("x").alias("y"))
    return pick.join(back, ["dataset", "x", "y"]).where("x < y").select("dataset", F.col("y").alias("src"), F.col("x").alias("dst"))


def _joined(stats: DataFrame, moves: DataFrame) -> DataFrame:
    """The statistics of merged clusters, from those of their halves alone."""
    one = _fresh(stats).select("dataset", F.col("cluster_id").alias("src"), F.col("n").alias("n1"), F.col("ok").alias("ok1"), F.col("s").alias("s1"), F.col("c").alias("c1"))
    both = moves.join(one, ["dataset", "src"]).join(_fresh(stats).withColumnRenamed("cluster_id", "dst"), ["dataset", "dst"])
    n = F.col("n") + F.col("n1")
    both = both.select("dataset", F.col("dst").alias("cluster_id"), n.alias("n"), "n_all", (F.col("ok") & F.col("ok1")).alias("ok"), F.zip_with("s", "s1", lambda x, y: x + y).alias("s"),
                       F.zip_with("c", "c1", lambda x, y: (x * F.col("n") + y * F.col("n1")) / n).alias("c"))
    size = F.col("n").cast("double")
    phi = (F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x) / F.size("s") - size) / (size * (size - 1))
    return both.select(*CLUSTER, "n", "n_all", "ok", F.when(F.col("ok"), phi).alias("phi"), "s", "c")


def _merge_block(n: np.ndarray, n_all: np.ndarray, ok: np.ndarray, phi: np.ndarray, s: np.ndarray, c: np.ndarray, threshold: float, wanted, max_rounds: int | None) -> np.ndarray:
    """Where each cluster of one data set ends, when pairs that are each other's best choice merge until none is left.

    Clusters come in the order of their ids. ``wanted(gain, phi_union, phi_a, phi_b, n_a, n_b)`` gives the choice, NaN for a pair that is not wanted.
    """
    k, m = s.shape
    n, ok, phi, s, c, at = n.copy(), ok.copy(), phi.copy(), s.copy(), c.copy(), np.arange(k)
    unit, best = np.zeros_like(c), np.full((k, k), -np.inf)

    def tested(fresh: np.ndarray) -> None:
        """Choices of pairs with a cluster that has just come to be."""
        d = c[fresh] - c[fresh].mean(axis=1, keepdims=True)
        size = np.linalg.norm(d, axis=1, keepdims=True)
        unit[fresh] = np.where(size > 1e-9, d / np.where(size > 1e-9, size, 1), np.nan)
        live = np.unique(at)
        for f in np.array_split(fresh, -(-len(fresh) * len(live) * m // BATCH)):
            i, j = np.nonzero(np.round(unit[f] @ unit[live].T, 9) >= threshold)
            i, j = f[i], live[j]
            i, j = i[i != j], j[i != j]
            both = n[i] + n[j]
            union = (((s[i] + s[j]) ** 2).sum(axis=1) / m - both) / (both * (both - 1))
            gain = (union - phi[i] * phi[j] / n_all[i]) / (2 * n_all[i])
            choice = np.where(np.isnan(gain), np.nan, wanted(gain, union, phi[i], phi[j], n[i], n[j]))
            best[i, j] = best[j, i] = np.where(np.isnan(choice), -np.inf, choice.round(12))

    tested(at)
    for _ in count() if max_rounds is None else range(max_rounds):
        # of equal choices the smallest id
        pick = best.argmax(axis=1)
        dst = np.flatnonzero((best[np.arange(k), pick] > -np.inf) & (pick[pick] == np.arange(k)) & (pick > np.arange(k)))
        if not len(dst):
            break
        src = pick[dst]
        n_new = n[dst] + n[src]
        c[dst] = (c[dst] * n[dst][:, None] + c[src] * n[src][:, None]) / n_new[:, None]
        s[dst], n[dst], ok[dst] = s[dst] + s[src], n_new, ok[dst] & ok[src]
        phi[dst] = np.where(ok[dst], ((s[dst] ** 2).sum(axis=1) / m - n_new) / (n_new * (n_new - 1.0)), np.nan)
        for gone in (src, dst):
            best[gone], best[:, gone] = -np.inf, -np.inf
        hop = np.arange(k)
        hop[src] = dst
        at = hop[at]
        tested(dst)
    return at


def _merge_rounds(cells: DataFrame, assignment: DataFrame, threshold: float, choice: Column, wanted, max_rounds: int | None) -> DataFrame:
    """The assignment after merging pairs that are each other's best ``choice`` (null: not wanted) until none is left; ``wanted`` is the same choice for arrays.

    The series are read once, for the statistics of the first clusters. The statistics of a data set with at most ``MERGE_CLUSTERS`` clusters
    merge inside one task. In others a round joins the statistics of the merged, keeps the tested pairs of all others, and tests the merged against the rest.
    """
    asg = cut_lineage(assignment.select(*SERIES, "cluster_id"))
    stats = cluster_stats(cells.join(asg, SERIES))
    few = (F.count(F.lit(1)).over(W.partitionBy("dataset")) <= MERGE_CLUSTERS) & (F.sum(F.size("s")).over(W.partitionBy("dataset")) <= BLOCK_VALUES)
    stats = cut_lineage(stats.withColumn("few", few))

    def settle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster_id")
        ids, wide = pdf["cluster_id"].to_numpy(), lambda name: np.stack(pdf[name].to_numpy()).astype(float)
        at = _merge_block(pdf["n"].to_numpy(), pdf["n_all"].to_numpy(), pdf["ok"].to_numpy(), pdf["phi"].to_numpy(dtype=float, na_value=np.nan), wide("s"), wide("c"), threshold, wanted, max_rounds)
        return pd.DataFrame({"dataset": key[0], "cluster_id": ids, "now": ids[at]})

    now = stats.where("few").drop("few").groupBy("dataset").applyInPandas(settle, f"{key_schema(asg, CLUSTER)}, now bigint")
    large = stats.where("NOT few").drop("few")
    if not large.isEmpty():
        now = now.unionByName(_merge_large(large, threshold, choice, max_rounds))
    return asg.join(cut_lineage(now), CLUSTER).select(*SERIES, F.col("now").alias("cluster_id"))


def _merge_large(stats: DataFrame, threshold: float, choice: Column, max_rounds: int | None) -> DataFrame:
    """(dataset, cluster_id, now): where each cluster ends, by rounds over all data sets."""
    n = _parts(stats)
    pairs = cut_lineage(similar_clusters(stats, threshold).withColumn("choice", choice))
    now = stats.select(*CLUSTER, F.col("cluster_id").alias("now"))
    # each round merges at least one pair, so the loop ends
    for _ in count() if max_rounds is None else range(max_rounds):
        moves = cut_lineage(_matched(pairs.where("choice IS NOT NULL"), "choice"))
        if moves.isEmpty():
            break
        gone = moves.select("dataset", F.explode(F.array("src", "dst")).alias("cluster_id"))
        merged = cut_lineage(_joined(stats, moves))
        stats = cut_lineage(stats.join(gone, CLUSTER, "left_anti").unionByName(merged).coalesce(n))
        kept = pairs
        for side in ("a", "b"):
            kept = kept.join(_fresh(gone).withColumnRenamed("cluster_id", side), ["dataset", side], "left_anti")
        pairs = cut_lineage(kept.unionByName(similar_clusters(stats, threshold, merged).withColumn("choice", choice)).coalesce(n))
        hop = moves.select("dataset", F.col("src").alias("now"), "dst")
        now = cut_lineage(now.join(hop, ["dataset", "now"], "left").select(*CLUSTER, F.coalesce("dst", "now").alias("now")))
    return now


def merge_clusters(df: DataFrame, assignment: DataFrame, threshold: float = SIMILAR, far: float = FAR, max_rounds: int | None = None) -> DataFrame:
    """Merge similar clusters with positive gain, round by round; then move series far
    from their centroid to the cluster with the best positive gain.

    In a round, clusters that are each other's best choice merge.
    """
    # statistics, distances to centroids and vectors all read the series: they are built once
    cells = cut_lineage(df.select(*SERIES, "t", "value"))
    gain = F.when(F.col("gain") > 0, F.col("gain"))
    asg = _merge_rounds(cells, assignment, threshold, gain, lambda g, *_: np.where(g > 0, g, np.nan), max_rounds)
    return _move_far(cells, asg, far)


def _move_far(cells: DataFrame, asg: DataFrame, far: float) -> DataFrame:
    full = cells.join(asg, SERIES)
    stats = cluster_stats(full)
    lost = far_from_centroid(full, far).select(*SERIES, "cluster_id")
    home = stats.select(*CLUSTER, "phi", "n_all")
    z = z_arrays(cells)
    left = lost.join(home, CLUSTER).where("phi IS NOT NULL").join(z, SERIES).select(
        "dataset", F.col("series_id").alias("bid"), "cluster_id", "phi", "n_all", "vals")
    right = stats.where("phi IS NOT NULL").select("dataset", F.col("cluster_id").alias("bid"), "n", "phi", "s")

    def best(key, a, b):
        cols = ["dataset", "series_id", "gain", "to"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)
        s, ids, n, phi = np.stack(b["s"].to_numpy()).astype(float), b["bid"].to_numpy(), b["n"].to_numpy(), b["phi"].to_numpy()
        out = []
        for sid, own, p, total, v in zip(a["bid"], a["cluster_id"], a["phi"], a["n_all"], a["vals"]):
            union = (((s + v) ** 2).sum(axis=1) / s.shape[1] - (n + 1)) / ((n + 1) * n)
            gain = np.where(ids == own, -np.inf, (union - p * phi / total) / (2 * total)).round(12)
            j = int(np.lexsort((ids, -gain))[0])
            out.append((key[0], sid, float(gain[j]), int(ids[j])))
        return pd.DataFrame(out, columns=cols)

    found = block_pairs(left, right, ["dataset"], best, "dataset string, series_id bigint, gain double, to bigint")
    pick = found.where("gain > 0").groupBy(*SERIES).agg(F.max_by("to", F.struct("gain", (-F.col("to")).alias("o"))).alias("to"))
    return asg.join(pick, SERIES, "left").select(*SERIES, F.coalesce("to", "cluster_id").alias("cluster_id"))


def merge_clusters_ratio(df: DataFrame, assignment: DataFrame, threshold: float = SIMILAR, ratio: float = 0.80,
                         ratio_single: float = 0.75, max_rounds: int | None = None) -> DataFrame:
    """Older rule: merge when the mean correlation of the union is at least ``ratio`` of
    the other cluster's, best difference first."""
    need = lambda n: F.when(F.col(n) > 1, ratio).otherwise(ratio_single)
    into_b = div("phi_union", "phi_b") >= need("n_b")
    into_a = div("phi_union", "phi_a") >= need("n_a")
    diff = F.greatest(F.when(into_b, F.col("phi_union") - F.col("phi_b")), F.when(into_a, F.col("phi_union") - F.col("phi_a")))

    def wanted(gain, union, phi_a, phi_b, n_a, n_b):
        least = lambda n: np.where(n > 1, ratio, ratio_single)
        part = lambda phi, n: np.where(np.where(phi != 0, union / np.where(phi != 0, phi, 1.0), -np.inf) >= least(n), union - phi, np.nan)
        return np.fmax(part(phi_b, n_b), part(phi_a, n_a))

    return _merge_rounds(cut_lineage(df.select(*SERIES, "t", "value")), assignment, threshold, diff, wanted, max_rounds)


def cross_sums(arr: DataFrame) -> DataFrame:
    """(dataset, a, b, total, pairs): sum of the best cross-correlations between the series of each cluster ``a`` that is
    ``small`` and each other cluster ``b``. ``arr``: dataset, cluster_id, series_id, vals, small."""
    cols = ["dataset", "a", "b", "total", "pairs"]

    def cross(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)
        best = Spectra(a["vals"].to_numpy()).best(Spectra(b["vals"].to_numpy()))
        (ca, one), (cb, two) = pd.factorize(a["cluster_id"]), pd.factorize(b["cluster_id"])
        total = (ca == np.arange(len(one))[:, None]).astype(float) @ best @ (cb[:, None] == np.arange(len(two))).astype(float)
        out = pd.DataFrame({"a": np.repeat(one, len(two)), "b": np.tile(two, len(one)), "total": total.ravel(), "pairs": np.outer(np.bincount(ca), np.bincount(cb)).ravel()})
        return out[out["a"] != out["b"]].assign(dataset=key[0])[cols]

    side = arr.select("dataset", F.col("series_id").alias("bid"), "cluster_id", "vals", "small")
    x = block_pairs(side.where("small"), side, ["dataset"], cross, "dataset string, a bigint, b bigint, total double, pairs bigint")
    return x.groupBy("dataset", "a", "b").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def merge_small_clusters(df: DataFrame, assignment: DataFrame, least: int = MIN_SERIES, max_rounds: int | None = None) -> DataFrame:
    """Join clusters with fewer than ``least`` series to the sibling that gains most in
    mean cross-correlation, among those that make the union large enough.

    Cross sums between small clusters and all series of the data set are formed once, block
    by block; those of a union are the sums of its parts', so no round reads a series. In a round the small clusters that no
    other small cluster waits for move; a data set that stays too small keeps its clusters.
    """
    arr = series_to_array(df.select(*SERIES, "t", "value"))
    asg = cut_lineage(assignment.select(*SERIES, "cluster_id"))
    sizes = asg.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("n"))
    full = cut_lineage(arr.join(asg, SERIES).join(sizes.withColumn("small", F.col("n") < least).select(*CLUSTER, "small"), CLUSTER))
    inner = mean_ncc_arrays(full, CLUSTER).join(sizes, CLUSTER)
    # total and pairs inside each cluster, a lone series with none
    inner = cut_lineage(inner.select(*CLUSTER, "n", (F.col("mean_ncc") * F.col("pairs")).alias("total"), "pairs"))
    x = cut_lineage(cross_sums(full))
    asg_now = None
    # each round merges at least one pair, so the loop ends
    for _ in count() if max_rounds is None else range(max_rounds):
        mean = F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).otherwise(1.0)
        side = lambda c: inner.select("dataset", F.col("cluster_id").alias(c), F.col("n").alias(f"n{c}"), F.col("total").alias(f"t{c}"), F.col("pairs").alias(f"p{c}"), mean.alias(f"m{c}"))
        cand = x.join(side("a"), ["dataset", "a"]).join(side("b"), ["dataset", "b"]).where((F.col("na") < least) & (F.col("na") + F.col("nb") >= least))
        union = (F.col("total") + F.col("ta") + F.col("tb")) / (F.col("pairs") + F.col("pa") + F.col("pb"))
        pick = cand.groupBy("dataset", F.col("a").alias("src")).agg(
            F.max_by("b", F.struct(F.round(union - F.col("mb"), 9), (-F.col("b")).alias("o"))).alias("dst"))
        # a cluster that moves cannot receive in the same round; of a mutual pair the larger id moves
        busy = pick.select("dataset", F.col("src").alias("dst"), F.col("dst").alias("next"))
        go = pick.join(busy, ["dataset", "dst"], "left").where("next IS NULL OR (next = src AND src > dst)").select("dataset", "src", "dst")
        # where all wait for each other in a ring, the smallest goes
        ring = pick.join(go.select("dataset").distinct(), "dataset", "left_anti").groupBy("dataset").agg(F.min(F.struct("src", "dst")).alias("m")).select("dataset", "m.*")
        moves = cut_lineage(go.unionByName(ring))
        if moves.isEmpty():
            break
        x, inner = _after(x, inner, moves)
        first = asg.select(*CLUSTER, F.col("cluster_id").alias("now")).distinct() if asg_now is None else asg_now
        asg_now = cut_lineage(first.join(moves.select("dataset", F.col("src").alias("now"), "dst"), ["dataset", "now"], "left").select(*CLUSTER, F.coalesce("dst", "now").alias("now")))
    return asg if asg_now is None else asg.join(asg_now, CLUSTER).select(*SERIES, F.col("now").alias("cluster_id"))


def _after(x: DataFrame, inner: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross sums and inner sums after small clusters have moved into others; several may move into one."""
    name = lambda c: moves.select("dataset", F.col("src").alias(c), F.col("dst").alias(f"{c}_to"))
    to_a, to_b = F.coalesce("a_to", "a"), F.coalesce("b_to", "b")
    new = x.join(name("a"), ["dataset", "a"], "left").join(name("b"), ["dataset", "b"], "left")
    # two small clusters have a row in both directions; a pair inside a union counts once
    inside = new.where(to_a == to_b).groupBy("dataset", to_a.alias("cluster_id"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(
        F.max("total").alias("total"), F.max("pairs").alias("pairs"))
    parts = inner.join(moves.select("dataset", F.col("src").alias("cluster_id"), "dst"), CLUSTER, "left").select(
        "dataset", F.coalesce("dst", "cluster_id").alias("cluster_id"), "n", "total", "pairs")
    sums = parts.unionByName(inside.select(*CLUSTER, F.lit(0).cast("bigint").alias("n"), "total", "pairs"))
    sums = sums.groupBy(*CLUSTER).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    # what has moved or received is large enough, and needs no partner of its own
    home = moves.select("dataset", F.col("dst").alias("a")).distinct()
    left = new.where("a_to IS NULL").join(home, ["dataset", "a"], "left_anti")
    left = left.groupBy("dataset", "a", to_b.alias("b")).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return cut_lineage(left), cut_lineage(sums)


def apply_constraints(df: DataFrame, assignment: DataFrame, least: int = MIN_SERIES, most: int = MAX_SERIES) -> DataFrame:
    return explode_large_clusters(merge_small_clusters(df, assignment, least), most)


# --- choosing k -----------------------------------------------------------------------

def gridsearch_range(profile: DataFrame) -> DataFrame:
    """Cluster counts to try per data set, from its number of series and complexity."""
    tests = F.lit(GRID_TESTS[-1][1])
    for bound, n in reversed(GRID_TESTS[:-1]):
        tests = F.when(F.col("complexity") < bound, n).otherwise(tests)
    most = F.col("n_series") / 2
    step = F.greatest(F.ceil(most / tests), F.lit(1))
    last = F.ceil(most + 1) - 1
    ks = F.when(last >= 2, F.sequence(F.lit(2).cast("bigint"), last.cast("bigint"), step.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return profile.select("dataset", "n_series", "complexity", ks.alias("ks"))


def nb_runs(profile: DataFrame, runs: dict = GRID_RUNS) -> DataFrame:
    size = F.when(F.col("complexity") <= 50_000, runs["small"]).when(F.col("length") > 5000, runs["large"]).otherwise(runs["medium"])
    return profile.select("dataset", size.alias("runs"))


def _runs(df: DataFrame, plan: DataFrame, rounds: int) -> DataFrame:
    """Cluster every (dataset, k, seed) of the plan in the same rounds."""
    return _clustered(z_arrays(df), plan.withColumn("start", F.col("seed")), rounds)


def _clustered(z: DataFrame, plan: DataFrame, rounds: int) -> DataFrame:
    """The runs (dataset, k, seed) of the plan, each from the centroids of its ``start``.

    The runs of a data set that fits one task are dealt to at most ``COPIES`` tasks, the longest ones to different tasks; each holds the series once. Larger
    data sets run in rounds over blocks.
    """
    plan = plan.select("dataset", F.col("k").alias("run_k"), F.col("seed").alias("run_seed"), F.col("start").cast("bigint").alias("seed"))
    size = z.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vals")).alias("m"))
    turn = F.pmod(F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("run_k"), "run_seed")), F.lit(COPIES))
    few = (F.col("n") * F.col("m") <= BLOCK_VALUES) & (F.col("n") * F.max("run_k").over(W.partitionBy("dataset")) <= BLOCK_TABLE)
    plan = cut_lineage(plan.join(size, "dataset").select("dataset", "run_k", "run_seed", "seed", turn.alias("copy"), few.alias("few")))
    ours = plan.where("few").select("dataset", "copy", "run_k", "run_seed", "seed")
    cols = [*RUN, "series_id", "cluster_id"]

    def settle(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)
        a = a.sort_values("series_id")
        sid, rows = a["series_id"].to_numpy(), np.stack(a["vals"].to_numpy()).astype(float)
        series = Spectra(rows)
        out = [pd.DataFrame({"dataset": key[0], "run_k": k, "run_seed": run, "series_id": sid, "cluster_id": _kshape_block(sid, rows, k, seed, rounds, series)[0]})
               for k, run, seed in zip(b["run_k"].to_list(), b["run_seed"].to_list(), b["seed"].to_list())]
        return pd.concat(out)[cols]

    tasks = cut_lineage(ours.select("dataset", "copy").distinct())
    # so many partitions that long tasks seldom share one
    n = max(_parts(z), min(4 * tasks.count(), TASKS))
    copies = z.select("dataset", "series_id", "vals").join(tasks, "dataset").repartition(n, "dataset", "copy")
    head = f"{key_schema(plan, RUN)}, series_id bigint, cluster_id bigint"
    out = copies.groupBy("dataset", "copy").cogroup(_fresh(ours).repartition(n, "dataset", "copy").groupBy("dataset", "copy")).applyInPandas(settle, head)
    large = plan.where("NOT few")
    if not large.isEmpty():
        arr = z.join(large.withColumn("k", F.col("run_k")), "dataset")
        out = out.unionByName(kshape(arr.select(*RUN, "series_id", "vals", "k", "seed"), RUN, rounds))
    return cut_lineage(out)


def _valid_runs(df: DataFrame, plan: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The runs of the plan, and those of them (dataset, run_k, run_seed) whose clusters all have two members at least.

    A run with a smaller cluster is rejected and clustered again from other centroids, at most ``MAX_RETRIES`` times;
    a run without a valid clustering keeps its last one. Retries of all data sets go in the same rounds.
    """
    z = cut_lineage(z_arrays(df))
    todo = cut_lineage(plan.withColumn("start", F.col("seed")))
    n = todo.groupBy("dataset").agg((F.max("seed") + 1).alias("n_runs"))
    runs, valid = None, None
    for turn in range(MAX_RETRIES + 1):
        tried = _clustered(z, todo, rounds)
        sizes = tried.groupBy(*RUN, "cluster_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*RUN).agg((F.min("n") >= 2).alias("ok"))
        sizes = cut_lineage(sizes)
        good = sizes.where("ok").select(*RUN)
        valid = good if valid is None else valid.unionByName(good)
        left = sizes.where("NOT ok").select("dataset", F.col("run_k").alias("k"), F.col("run_seed").alias("seed"))
        last = turn == MAX_RETRIES or left.isEmpty()
        keep = tried if last else tried.join(good, RUN, "left_semi")
        runs = keep if runs is None else runs.unionByName(keep)
        if last:
            break
        # seeds that no run and no earlier try has used
        todo = cut_lineage(left.join(n, "dataset").withColumn("start", F.col("seed") + (turn + 1) * F.col("n_runs")).drop("n_runs"))
    return runs, valid


def run_scores(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Score of each run: mean over its clusters of their mean cross-correlation; 0 when
    a cluster has fewer than two members. Also the number of clusters.

    Only runs without such a cluster are compared. A pair has the same correlation in every run that joins it: where the runs of a data set
    join more pairs than there are, each pair is compared once for all of them.
    """
    runs = cut_lineage(runs.select(*RUN, "series_id", "cluster_id"))
    sizes = cut_lineage(runs.groupBy(*RUN, "cluster_id").agg(F.count(F.lit(1)).alias("n")))
    per_run = cut_lineage(sizes.groupBy(*RUN).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("joined")))
    fine = per_run.where("least > 1")
    cost = fine.groupBy("dataset").agg((F.sum("joined") + F.sum("n_clusters") * 2 * GROUP_PAIRS >= F.max(F.col("n") * (F.col("n") - 1))).alias("once"))
    fine = cut_lineage(fine.select(*RUN).join(cost, "dataset"))
    arr = series_to_array(df.select(*SERIES, "t", "value"))
    fields = [*RUN, "cluster_id"]
    own = runs.join(fine.where("NOT once").select(*RUN), RUN)
    mean = mean_ncc_arrays(arr.join(own, SERIES), fields).select(*fields, "mean_ncc")
    once = _shared_totals(arr, runs.join(fine.where("once").select(*RUN), RUN)).join(sizes, fields)
    once = once.select(*fields, (F.col("total") / (F.col("n") * (F.col("n") - 1) / 2)).alias("mean_ncc"))
    score = mean.unionByName(once).groupBy(*RUN).agg(F.avg("mean_ncc").alias("score"))
    return per_run.join(score, RUN, "left").select(*RUN, F.when(F.col("least") > 1, F.col("score")).otherwise(0.0).alias("score"), "n_clusters")


def _shared_totals(arr: DataFrame, runs: DataFrame) -> DataFrame:
    """(dataset, run_k, run_seed, cluster_id, total): sum of the best cross-correlations inside each cluster, with every pair of a data set compared once."""
    entry = F.struct("run_k", "run_seed", F.col("cluster_id").cast("int").alias("c"))
    # as many labels as the data set has runs, in the same order for every series
    labels = runs.groupBy(*SERIES).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    place = runs.select(*RUN).distinct().withColumn("run", F.row_number().over(W.partitionBy("dataset").orderBy("run_k", "run_seed")) - 1)
    side = arr.join(labels, SERIES).select("dataset", F.col("series_id").alias("bid"), "vals", F.transform("l", lambda x: x["c"]).alias("labels"))
    cols = ["dataset", "run", "cluster_id", "total"]

    def score(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=cols)
        best = pair_table(key, a, b)
        one, two = np.stack(a["labels"].to_numpy()).T, np.stack(b["labels"].to_numpy()).T
        out = []
        for run, (x, y) in enumerate(zip(one, two)):
            total = np.zeros(len(x))
            # a few rows at a time keep the comparison small
            for i in range(0, len(x), BLOCK):
                same = x[i:i + BLOCK, None] == y[None, :]
                total[i:i + BLOCK] = np.einsum("ij,ij->i", best[i:i + BLOCK], same)
            code, names = pd.factorize(x)
            out.append(pd.DataFrame({"dataset": key[0], "run": run, "cluster_id": names, "total": np.bincount(code, total)}))
        return pd.concat(out)[cols]

    parts = half_pairs(side, ["dataset"], score, f"{key_schema(arr, ['dataset'])}, run int, cluster_id bigint, total double", 4 * _parts(arr))
    return parts.groupBy("dataset", "run", "cluster_id").agg(F.sum("total").alias("total")).join(place, ["dataset", "run"]).select(*RUN, "cluster_id", "total")


def cluster_gridsearch(df: DataFrame, ks: list[int] | None = None, seeds: int | None = None, rounds: int = KSHAPE_ROUNDS, enough: float = 0.95) -> DataFrame:
    """The k with the best average run score per data set. Data sets whose mean
    cross-correlation reaches ``enough``, or that are too small to part, need no clusters
    (k = 1). Counts and runs follow ``gridsearch_range`` and ``nb_runs`` unless given."""
    # the profile, the correlations, the runs and their scores all read the series: they are built once
    df = cut_lineage(df.select(*SERIES, "t", "value"))
    profile = dataset_profile(df)
    tries = gridsearch_range(profile).select("dataset", "ks") if ks is None else profile.select("dataset", F.array(*[F.lit(k).cast("bigint") for k in ks]).alias("ks"))
    tries = tries.join(nb_runs(profile) if seeds is None else profile.select("dataset", F.lit(seeds).alias("runs")), "dataset")
    whole = mean_ncc(df, ["dataset"], 4 * _parts(df)).withColumn("easy", F.col("mean_ncc") >= enough)
    whole = whole.join(tries, "dataset").withColumn("easy", F.coalesce("easy", F.lit(False)) | (F.size("ks") == 0))
    plan = whole.where("NOT easy").select("dataset", "runs", F.explode("ks").alias("k")).select(
        "dataset", "k", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("seed"))
    runs = _runs(df, plan, rounds)
    per_k = run_scores(df, runs).groupBy("dataset", "run_k").agg(F.avg("score").alias("score"))
    best = per_k.groupBy("dataset").agg(F.max_by(F.struct(F.col("run_k").alias("k"), "score"), F.struct(F.round("score", 9), (-F.col("run_k")).alias("o"))).alias("b"))
    hard = best.select("dataset", "b.k", "b.score")
    return hard.unionByName(whole.where("easy").select("dataset", F.lit(1).cast("bigint").alias("k"), F.col("mean_ncc").alias("score")))


def best_rerun(df: DataFrame, k: int | DataFrame, seeds: int | None = None, rounds: int = KSHAPE_ROUNDS) -> DataFrame:
    """Of several runs with different starts, the assignment of the best scored one.

    ``k`` is one number or a table (dataset, k); the number of runs follows ``nb_runs`` unless given. A run with a cluster of
    fewer than two series is rejected and tried again, at most ``MAX_RETRIES`` times, and scores 0 if none of its tries is valid.
    """
    df = cut_lineage(df.select(*SERIES, "t", "value"))
    profile = dataset_profile(df)
    runs = nb_runs(profile, FINAL_RUNS) if seeds is None else profile.select("dataset", F.lit(seeds).alias("runs"))
    counts = k.select("dataset", "k") if isinstance(k, DataFrame) else profile.select("dataset", F.lit(k).cast("bigint").alias("k"))
    plan = runs.join(counts, "dataset").select("dataset", "k", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("seed"))
    runs, valid = _valid_runs(df, plan, rounds)
    scores = run_scores(df, runs.join(valid, RUN, "left_semi")).select(*RUN, "score")
    every = runs.select(*RUN).distinct().join(scores, RUN, "left")
    best = every.groupBy("dataset").agg(F.max_by("run_seed", F.struct(F.round(F.coalesce("score", F.lit(0.0)), 9).alias("s"), (-F.col("run_seed")).alias("o"))).alias("run_seed"))
    return runs.join(best, ["dataset", "run_seed"], "left_semi").select(*SERIES, "cluster_id")


def cluster_all(df: DataFrame, accept: float = 0.75, accept_all: float = 0.9, threshold: float = SIMILAR) -> DataFrame:
    """Cluster all data sets in the same rounds: search k, keep the best rerun, refine,
    merge, constrain, and number the clusters globally."""
    df = cut_lineage(df)
    first = best_rerun(df, cluster_gridsearch(df))
    fine = incremental_cluster(df, accept, accept_all, start=first)
    merged = merge_clusters(df, fine.drop("converged"), threshold)
    out = apply_constraints(df, merged)
    return global_cluster_id(out.select(*SERIES, "cluster_id")).select(*SERIES, F.col("global_cluster_id").alias("cluster_id"))

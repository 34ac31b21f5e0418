"""Exact nearest neighbours and radius search between two tables.

Points are assigned to the nearest of a fixed number of pivots. Count and radius of
every cell bound the k-th distance of a query, so a query visits only the cells that
can hold one of its neighbours; nothing that could matter is skipped. Neighbouring
small cells share a bin, crowded cells are cut, so that a query is sent once per bin
and a bin is many small tasks, each of which returns only its own k best per query.
A task sees at most ``BUCKET`` rows of either side and ``BUCKET_VALUES`` numbers of
each, and holds the distances of ``PAIRS`` pairs at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gapmend.functions.columns import scatter

PIVOTS = 256
BUCKET = 16384
BUCKET_VALUES = 1 << 20
CELL_ROWS = 512
MERGE = 64
PAIRS = 1 << 20
# rows in one Arrow batch of routed queries
ROUTED = 4096


def _pivots(train: DataFrame) -> np.ndarray:
    """Up to PIVOTS scattered training points, one per CELL_ROWS rows."""
    n = max(1, min(PIVOTS, -(-train.count() // CELL_ROWS)))
    rows = train.select("id", "vec").orderBy(scatter("id"), "id").limit(n).collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, row of a x row of b."""
    return np.stack([np.sqrt(((b - x) ** 2).sum(axis=1)) for x in a]) if len(a) else np.zeros((0, len(b)))


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                d = _dist(np.stack(pdf["vec"].to_numpy()), pivots)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), off=d.min(axis=1))
    return df.mapInPandas(run, f"{head}, cell int, off double")


def _cells(train: DataFrame):
    """Count and radius per (grp, cell): at most groups x PIVOTS rows."""
    rows = train.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["grp"], []).append((r["cell"], r["n"], r["r"]))
    return out


def _bins(cells: dict, pivots: np.ndarray) -> tuple[dict, int]:
    """Bin of every (grp, cell), and how many rows one bucket may hold.

    Cells follow one axis through the pivots; one bin takes cells until it has a bucket of rows.
    """
    if not cells:
        return {}, BUCKET
    size = max(1, min(BUCKET, BUCKET_VALUES // pivots.shape[1]))
    centred = pivots - pivots.mean(axis=0)
    place = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    out = {}
    for grp, info in cells.items():
        bin_, filled = -1, size
        for cell, n, _ in sorted(info, key=lambda c: (place[c[0]], c[0])):
            if filled + n > size:
                bin_, filled = bin_ + 1, 0
            filled += n
            out[grp, cell] = bin_
    return out, size


def _route(query: DataFrame, pivots: np.ndarray, cells: dict, bins: dict, k: int | None, radius: float | None) -> DataFrame:
    """One row per (query, bin to visit)."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in query.schema)
    plan = {}
    for grp, info in cells.items():
        cell, n, r = (np.array(v) for v in zip(*info))
        at = np.array([bins[grp, c] for c in cell])
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        plan[grp] = cell[order], n[order], r[order], starts, at[order][starts]

    def visits(grp, d):
        """Rows of ``d`` and the bins they go to."""
        cell, n, r, starts, names = plan[grp]
        dist = d[:, cell]
        if radius is not None:
            limit = np.full(len(d), float(radius))
        else:
            far = dist + r
            order = np.argsort(far, axis=1)
            enough = np.minimum((np.cumsum(n[order], axis=1) < k).sum(axis=1), len(cell) - 1)
            limit = far[np.arange(len(d)), order[np.arange(len(d)), enough]]
        go = np.logical_or.reduceat(dist - r <= limit[:, None] + 1e-9, starts, axis=1)
        row, at = np.nonzero(go)
        return row, names[at]

    def run(batches):
        for pdf in batches:
            for grp, part in pdf.groupby("grp"):
                if grp not in plan:
                    continue
                row, at = visits(grp, _dist(np.stack(part["vec"].to_numpy()).astype(float), pivots))
                # a query may go to many bins: the copies leave in small batches
                for i in range(0, len(row), ROUTED):
                    yield part.iloc[row[i:i + ROUTED]].assign(bin=at[i:i + ROUTED].astype("int32"))
    return query.mapInPandas(run, f"{head}, bin int")


def _buckets(train: DataFrame, routed: DataFrame, cells: dict, bins: dict, size: int):
    """Key both sides by (grp, bin, a, b) so that no bucket exceeds ``size`` rows much."""
    visits = {(r["grp"], r["bin"]): r["n"] for r in routed.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    held: dict = {}
    for grp, info in cells.items():
        for c, n, _ in info:
            held[grp, bins[grp, c]] = held.get((grp, bins[grp, c]), 0) + n
    spark = train.sparkSession
    rows = [(g, int(c), int(bins[g, c]), int(-(-held[g, bins[g, c]] // size)), int(-(-visits.get((g, bins[g, c]), 1) // size))) for g, info in cells.items() for c, _, _ in info]
    plan = spark.createDataFrame(rows, "grp string, cell int, bin int, na int, nb int")
    t = train.join(F.broadcast(plan), ["grp", "cell"]).withColumn("a", F.pmod(F.hash("id"), F.col("na"))).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    q = routed.join(F.broadcast(plan.drop("cell").distinct()), ["grp", "bin"]).withColumn("b", F.pmod(F.hash("id"), F.col("nb"))).withColumn(
        "a", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    keys = ["grp", "bin", "a", "b"]
    return (q.select(*keys, "id", "vec").groupBy(*keys),
            t.select(*keys, F.col("id").alias("nid"), F.col("vec").alias("nvec"), "label").groupBy(*keys))


def _plan(query: DataFrame, train: DataFrame, k: int | None, radius: float | None):
    """Both sides in their buckets."""
    train = _prepare(train).select("id", "vec", "label", "grp")
    query = _prepare(query).select("id", "vec", "grp")
    pivots = _pivots(train)
    placed = _assign(train, pivots)
    cells = _cells(placed)
    bins, size = _bins(cells, pivots)
    return _buckets(placed, _route(query, pivots, cells, bins, k, radius), cells, bins, size)


def _squares(q: np.ndarray, t: np.ndarray):
    """For slices of ``q``: first row, squared distances to all rows of ``t`` from one matrix product, and a bound of their error."""
    tt = (t ** 2).sum(axis=1)
    step = max(1, PAIRS // len(t))
    for i in range(0, len(q), step):
        x = q[i:i + step]
        qq = (x ** 2).sum(axis=1)[:, None]
        d2 = x @ t.T
        d2 *= -2
        d2 += qq
        d2 += tt
        yield i, d2, 4 * (t.shape[1] + 4) * np.finfo(float).eps * (qq + tt.max())


def _exact(q: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of row i of ``q`` and row j of ``t``, to 9 digits."""
    step = max(1, PAIRS // q.shape[1])
    parts = [((t[j[s:s + step]] - q[i[s:s + step]]) ** 2).sum(axis=1) for s in range(0, len(i), step)]
    return np.round(np.sqrt(np.concatenate(parts)), 9) if parts else np.zeros(0)


def _nearest(q: np.ndarray, t: np.ndarray, nid: np.ndarray, k: int):
    """(row of q, row of t, distance) of the k nearest by (distance to 9 digits, id).

    The matrix product only leaves out pairs that its error and the rounding cannot bring among the k; the others are computed from differences.
    """
    k = min(k, len(t))
    groups = min(len(t), max(64, 2 * k))
    starts = np.arange(groups) * len(t) // groups
    out = []
    for i, d2, err in _squares(q, t):
        # the k-th of the smallest values of parts is no less than the k-th smallest of all
        top = np.partition(np.minimum.reduceat(d2, starts, axis=1), k - 1, axis=1)[:, k - 1:k]
        limit = (np.sqrt(np.maximum(top + err, 0)) + 2e-9) ** 2 + err
        a, b = np.nonzero(d2 <= limit)
        d = _exact(q[i:i + len(d2)], t, a, b)
        order = np.lexsort((nid[b], d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        out.append((a[keep] + i, b[keep], d[keep]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _tally(q: np.ndarray, t: np.ndarray, code: np.ndarray, radius: float):
    """(row of q, code, votes, exact, weight) of neighbours within ``radius``, per code of ``t``.

    Distances from the matrix product serve where they are far from 0 and from the radius; the others are computed from differences.
    """
    order = np.argsort(code, kind="stable")
    t, code = t[order], code[order]
    starts = np.flatnonzero(np.r_[True, np.diff(code) > 0])
    out = []
    for i, d2, err in _squares(q, t):
        low, high = max(radius - 1e-7, 0.0) ** 2, (radius + 1e-7) ** 2
        a, b = np.nonzero((d2 <= 1e9 * err) & (d2 <= high + err) | (d2 >= low - err) & (d2 <= high + err))
        d = np.sqrt(np.maximum(d2, 0, out=d2), out=d2)
        d[a, b] = _exact(q[i:i + len(d2)], t, a, b)
        near = d <= radius
        zero = d == 0
        w = np.divide(1.0, d, out=np.zeros_like(d), where=near & ~zero)
        add = lambda x, kind: np.add.reduceat(x, starts, axis=1, dtype=kind)
        votes = add(near, np.int64)
        row, at = np.nonzero(votes)
        out.append((row + i, code[starts][at], votes[row, at], add(zero, np.int64)[row, at], add(w, float)[row, at]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _prepare(df: DataFrame) -> DataFrame:
    out = df if "grp" in df.columns else df.withColumn("grp", F.lit(""))
    return out if "label" in out.columns else out.withColumn("label", F.lit(None).cast("string"))


def knn_join(query: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """The k nearest training points of every query, nearest first.

    ``query``: (id, vec[, grp]); ``train``: (id, vec[, label, grp]). With ``grp`` only
    points of the same group are neighbours. Returns (id, near) with near an array of
    (dist, nid, label); equal distances (9 digits) are ordered by id.
    """
    left, right = _plan(query, train, k, None)

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = ["id", "dist", "nid", "label"]
        if not len(q) or not len(t):
            return pd.DataFrame(columns=cols)
        nid = t["nid"].to_numpy()
        row, at, dist = _nearest(np.stack(q["vec"].to_numpy()).astype(float), np.stack(t["nvec"].to_numpy()).astype(float), nid, k)
        return pd.DataFrame({"id": q["id"].to_numpy()[row], "dist": dist, "nid": nid[at], "label": t["label"].to_numpy()[at]})[cols]

    found = left.cogroup(right).applyInPandas(best, "id bigint, dist double, nid bigint, label string")
    # buckets are merged in two steps, so that a query with many buckets stays small
    keep = lambda c: F.slice(F.array_sort(c), 1, k)
    first = found.groupBy("id", F.pmod(F.hash("nid"), F.lit(MERGE)).alias("m")).agg(
        keep(F.collect_list(F.struct("dist", "nid", "label"))).alias("near"))
    return first.groupBy("id").agg(keep(F.flatten(F.collect_list("near"))).alias("near"))


def radius_votes(query: DataFrame, train: DataFrame, radius: float) -> DataFrame:
    """(id, label, votes, weight): neighbours within ``radius`` counted per label, and
    the sum of 1 / distance (NULL when one is at distance 0; then see ``exact``)."""
    left, right = _plan(query, train, None, radius)

    def count(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = ["id", "label", "votes", "exact", "weight"]
        if not len(q) or not len(t):
            return pd.DataFrame(columns=cols)
        code, names = pd.factorize(t["label"], use_na_sentinel=False)
        row, at, votes, exact, weight = _tally(np.stack(q["vec"].to_numpy()).astype(float), np.stack(t["nvec"].to_numpy()).astype(float), code, radius)
        return pd.DataFrame({"id": q["id"].to_numpy()[row], "label": np.asarray(names)[at], "votes": votes, "exact": exact, "weight": weight})[cols]

    found = left.cogroup(right).applyInPandas(count, "id bigint, label string, votes bigint, exact bigint, weight double")
    return found.groupBy("id", "label").agg(F.sum("votes").alias("votes"), F.sum("exact").alias("exact"), F.sum("weight").alias("weight"))

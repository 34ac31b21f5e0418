"""Low-rank completion of clusters from moment sums, without a time axis in any task.

A step of a cluster is a vector over its (at most ``MAX_MEMBERS``) series. Every
imputer here fills the unknown entries of a step by a linear map of that vector which
depends only on the Gram matrix of the filled table. Starting from the series' means,
a filled entry therefore stays an affine function of the known entries of its step, and
steps with the same known series share that function. So Spark sums the products of
entries once per (cluster, share, set of known series); the rounds then run on these
small sums, and their result is one row of coefficients per set, joined to the steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gapmend.session import cut_lineage

CLUSTER = ["dataset", "cluster_id"]
MASK = ["dataset", "cluster_id", "series_id", "miss_perc"]
MAX_MEMBERS = 15
ALGORITHMS = ("svdimp", "softimp", "svt", "cdrec_k2", "cdrec_k3")
RANK = 3
#: Rounds end when imputed cells (svt: residuals of known cells) move by less than this share of their norm.
TOLERANCE = 1e-4
ROUNDS = 1000
#: Rounds that come back to an earlier state, to this share of its largest coefficient, run in a circle from there.
REPEAT = 1e-13
#: Sets of known series that are solved at once, and rows of sums that a group of clusters has on average.
SETS, ROWS = 1 << 10, 1 << 12


# --- how a round maps a step, from the Gram matrices over series of a stack of tables --

def _spectral(gram: np.ndarray, weight) -> np.ndarray:
    """U diag(weight(s)) U^T, s the singular values of the table behind each ``gram``."""
    w, u = np.linalg.eigh(gram)
    s = np.sqrt(np.maximum(w, 0.0))
    return (u * weight(s)[..., None, :]) @ u.swapaxes(-1, -2)


def _shrunk(s: np.ndarray, tau: np.ndarray) -> np.ndarray:
    return np.maximum(s - tau, 0.0) / np.where(s > 0, s, 1.0)


def _sign_vectors(gram: np.ndarray) -> np.ndarray:
    """Signs that (locally) maximise z^T gram z by single flips, for each table; each flip raises it."""
    z = np.ones(gram.shape[:2])
    diag = np.diagonal(gram, axis1=1, axis2=2)
    least = 1e-12 * diag.sum(axis=1)
    at = np.arange(len(gram))
    while True:
        gain = diag - z * (gram @ z[..., None])[..., 0]
        best = gain.argmax(axis=1)
        go = np.flatnonzero(gain[at, best] > least)
        if not len(go):
            return z
        z[go, best[go]] *= -1


def _sign_vector(gram: np.ndarray) -> np.ndarray:
    """The signs of one table."""
    return _sign_vectors(gram[None])[0]


def _centroid_map(gram: np.ndarray, k: int) -> np.ndarray:
    """The maps of tables to the sum of their first k centroid components."""
    m = gram.shape[-1]
    eye = np.eye(m)
    rest, g = np.broadcast_to(eye, gram.shape), gram
    none = 1e-24 * np.trace(gram, axis1=1, axis2=2)
    for _ in range(min(k, m)):
        z = _sign_vectors(g)
        gz = (g @ z[..., None])[..., 0]
        size = (z * gz).sum(axis=1)
        # what is left of a table may be nothing
        share = np.where(size > none, 1 / np.where(size > none, size, 1.0), 0.0)
        off = eye - (gz * share[:, None])[:, :, None] * z[:, None, :]
        rest, g = off @ rest, off @ g @ off.swapaxes(1, 2)
    return eye - rest


def _round_map(name: str, gram: np.ndarray) -> np.ndarray:
    if name == "svdimp":
        top = np.linalg.eigh(gram)[1][..., -RANK:]
        return top @ top.swapaxes(-1, -2)
    if name == "softimp":
        return _spectral(gram, lambda s: _shrunk(s, 0.05 * s.max(axis=1, keepdims=True)))
    return _centroid_map(gram, int(name[-1]))


def complete(name: str, sums: np.ndarray, known: np.ndarray, rounds: int, tol: float):
    """Run one imputer to rest on a stack of tables with equally many series.

    ``sums`` is (table, set, m + 1, m + 1): products of the m entries (unknown: 0) and a
    constant one, summed over the steps of a set; ``known`` is (table, set, m), and a table with
    fewer sets ends in known sets of zero sums. Returns (table, set, m + 1, m) coefficients of
    all entries, rounds, and which tables came to rest.
    """
    b, p, m = known.shape
    eye = np.zeros((b, p, m + 1, m))
    eye[:, :, np.arange(m), np.arange(m)] = known
    run = _shrink_residuals if name == "svt" else _refill
    return run(name, sums, known, eye, rounds, tol)


def _mostly_done(live: np.ndarray) -> bool:
    """Whether tables at rest, which run along unheeded, are worth taking out of the stack."""
    return 4 * live.sum() <= 3 * len(live)


def _shrink_residuals(name, sums, known, eye, rounds, tol):
    gap = ~known[:, :, None, :]
    out, took, rest = np.empty_like(eye), np.full(len(eye), rounds), np.zeros(len(eye), bool)
    y, push, left, live = eye, sums @ eye, np.arange(len(eye)), np.ones(len(eye), bool)  # push: sums @ y, moved along with y
    size = (eye * push).sum(axis=(1, 2, 3))
    gram = lambda: (y.swapaxes(2, 3) @ push).sum(axis=1)
    tau = 0.5 * np.sqrt(np.maximum(np.linalg.eigvalsh(gram())[:, -1:], 0.0))
    for n in range(1, rounds + 1):
        low = y @ _spectral(gram(), lambda s: _shrunk(s, tau))[:, None]
        miss = np.where(gap, 0.0, eye - low)
        more = sums @ miss
        done = live & ((miss * more).sum(axis=(1, 2, 3)) <= tol * tol * size)
        stop = live if n == rounds else done
        if stop.any():
            out[left[stop]] = np.where(gap[stop], low[stop], eye[stop])
            took[left[done]], rest[left[done]] = n, True
            live = live & ~stop
            if not live.any():
                break
            if _mostly_done(live):
                left, eye, gap, sums, y, push, miss, more, size, tau = (v[live] for v in (left, eye, gap, sums, y, push, miss, more, size, tau))
                live = live[live]
        y, push = y + 1.2 * miss, push + 1.2 * more
    return out, took, rest


def _refill(name, sums, known, eye, rounds, tol):
    b, p, m = known.shape
    count = np.einsum("bpm,bp->bm", known, sums[:, :, m, m])
    mean = sums[:, :, :m, m].sum(axis=1) / np.maximum(count, 1)
    out = eye
    out[:, :, m, :] = np.where(known, 0.0, mean[:, None])
    took, rest = np.full(b, rounds), np.zeros(b, bool)
    # sets without gaps stay as they are: only their share of the Gram matrix counts
    whole = known.all(axis=2)
    order = np.argsort(whole, axis=1, kind="stable")
    order = order[:, :max(1, int((~whole).sum(axis=1).max()))]
    at = np.arange(b)[:, None]
    gap, few = ~known[at, order][:, :, None, :], sums[at, order]
    full = out[at, order]
    base = sums[:, :, :m, :m].sum(axis=1, where=whole[:, :, None, None])
    # of the rows taken along, those without gaps are in ``base`` already
    few = np.where(whole[at, order][:, :, None, None], 0.0, few)
    push, left, end, live = few @ full, np.arange(b), np.full(b, rounds), np.ones(b, bool)
    seen = full
    for n in range(1, rounds + 1):
        low = full @ _round_map(name, base + (full.swapaxes(2, 3) @ push).sum(axis=1)).swapaxes(1, 2)[:, None]
        new = np.where(gap, low, full)
        fresh = few @ new
        moved = ((new - full) * (fresh - push)).sum(axis=(1, 2, 3))
        size = np.where(gap, new * fresh, 0.0).sum(axis=(1, 2, 3))
        full, push = new, fresh
        done = live & (moved <= tol * tol * size)
        took[left[done]], rest[left[done]] = n, True
        # a table whose rounds have begun to repeat only needs those that lead to the state of the last round
        same = np.abs(full - seen).max(axis=(1, 2, 3)) <= REPEAT * np.abs(full).max(axis=(1, 2, 3))
        again = same & live & (end == rounds)
        if n > 1 and again.any():
            end[again] = n + (rounds - n) % (n - mark)
        stop = done | (live & (end == n))
        if stop.any():
            out[left[stop, None], order[stop]] = full[stop]
            live = live & ~stop
            if not live.any():
                break
            if _mostly_done(live):
                left, order, full, push, seen, gap, few, base, end = (v[live] for v in (left, order, full, push, seen, gap, few, base, end))
                live = live[live]
        if n & (n - 1) == 0:
            seen, mark = full, n
    return out, took, rest


# --- the tables -----------------------------------------------------------------------

def members(cells: DataFrame) -> DataFrame:
    """(dataset, cluster_id, series_id, pos); an unbounded cluster is an error."""
    one = cells.select(*CLUSTER, "series_id").distinct()
    size = one.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") <= MAX_MEMBERS, F.col("n")).otherwise(F.raise_error(F.concat(
        F.lit(f"more than {MAX_MEMBERS} series, cut by explode_large_clusters first: cluster "), F.col("cluster_id").cast("string"))).cast("bigint"))
    few = one.join(size.withColumn("n", bound).where("n > 0"), CLUSTER)
    return few.select(*CLUSTER, "series_id", (F.row_number().over(
        W.partitionBy(*CLUSTER).orderBy("series_id")) - 1).alias("pos"))


def _steps(masked: DataFrame, cells: DataFrame, place: DataFrame) -> DataFrame:
    """One row per cluster and step: entries ``x`` with a last 1, bits of known series,
    and which masked copies hide it (``series:share`` joined by commas)."""
    key = F.concat_ws(":", "series_id", "miss_perc")
    hides = masked.where("hidden").select(*CLUSTER, "t", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("double").alias("value"), key.alias("h"))
    rows = cells.join(place, [*CLUSTER, "series_id"]).select(*CLUSTER, "t", "pos", "value", F.lit(None).cast("string").alias("h"))
    entry = [F.max(F.when(F.col("pos") == i, F.col("value"))) for i in range(MAX_MEMBERS)]
    wide = rows.unionByName(hides).groupBy(*CLUSTER, "t").agg(
        F.array(*entry).alias("v"), F.array_sort(F.collect_set("h")).alias("h"))
    bits = sum((F.when(F.col("v")[i].isNotNull(), 1 << i).otherwise(0) for i in range(MAX_MEMBERS)), F.lit(0))
    x = F.concat(F.transform("v", lambda e: F.coalesce(e, F.lit(0.0))), F.array(F.lit(1.0)))
    return wide.select(*CLUSTER, "t", bits.cast("int").alias("bits"), F.array_join("h", ",").alias("hides"), x.alias("x"))


def _set_sums(steps: DataFrame) -> DataFrame:
    """(dataset, cluster_id, bits, hides, s): products of entries, the upper triangle row by row, summed over the steps
    with the same known series and hiding copies."""
    a, b = np.triu_indices(MAX_MEMBERS + 1)
    products = [F.sum(F.col("x")[int(i)] * F.col("x")[int(j)]) for i, j in zip(a, b)]
    return steps.groupBy(*CLUSTER, "bits", "hides").agg(F.array(*products).alias("s"))


def _is_hidden():
    return F.array_contains(F.split("hides", ","), F.concat_ws(":", "series_id", "miss_perc"))


def _seen_bits():
    """Bits of the known series without the target where its copy hides it."""
    own = F.expr("shiftleft(1, pos)")
    return F.when(_is_hidden(), F.col("bits").bitwiseAND(F.bitwise_not(own))).otherwise(F.col("bits"))


def low_rank_fit(masked: DataFrame, cells: DataFrame, algorithms=ALGORITHMS, rounds: int = ROUNDS, tol: float = TOLERANCE) -> DataFrame:
    """(MASK, algorithm, bits, coef, rounds, converged): how each masked copy is filled
    where the known series are ``bits``, as coefficients of the entries of the step and
    a constant. A task holds the sums of a group of clusters, of about ``ROWS`` rows or one
    cluster: 136 numbers for each set of known series (at most 2^15) and of hiding copies that occurs,
    however many steps there are.
    """
    return _fit(*_inputs(masked, cells), list(algorithms), rounds, tol)


def _inputs(masked: DataFrame, cells: DataFrame):
    """Steps, masked rows and places, each computed once: both results below read them."""
    # fresh column identities: both sides often stem from the same cells
    cells = cells.select(*[F.col(c).alias(c) for c in (*CLUSTER, "series_id", "t", "value")])
    masked = cut_lineage(masked.select(*MASK, "t", "value", "hidden"))
    place = cut_lineage(members(cells))
    return cut_lineage(_steps(masked, cells, place)), masked, place


def _copy_sums(pdf: pd.DataFrame, s: np.ndarray, name: str, target: int):
    """(sets, their known series, sums) as one masked copy sees them."""
    hid = np.array([name in h.split(",") for h in pdf["hides"]], bool)
    bits = pdf["bits"].to_numpy()
    sets, at = np.unique(np.where(hid, bits & ~(1 << target), bits), return_inverse=True)
    seen = s.copy()
    seen[hid, target] = 0.0
    seen[hid, :, target] = 0.0
    sums = np.zeros((len(sets), *s.shape[1:]))
    np.add.at(sums, at, seen)
    return sets, (sets[:, None] >> np.arange(MAX_MEMBERS)) & 1 == 1, sums


def _fit(steps, masked, place, algorithms, rounds, tol):
    size = MAX_MEMBERS + 1
    upper = np.triu_indices(size)
    cols = [*MASK, "algorithm", "bits", "coef", "rounds", "converged"]

    def solve_stack(stack):
        """Rows of the result for masked copies with equally many series."""
        m, p = len(stack[0][2]), max(len(c[3]) for c in stack)
        sums, known = np.zeros((len(stack), p, m + 1, m + 1)), np.ones((len(stack), p, m), bool)
        for i, (_, _, use, sets, seen, part) in enumerate(stack):
            cut = np.append(use, MAX_MEMBERS)
            sums[i, :len(sets)], known[i, :len(sets)] = part[:, cut][:, :, cut], seen[:, use]
        for name in algorithms:
            coef, n, rest = complete(name, sums, known, rounds, tol)
            for i, (copy, target, use, sets, seen, _) in enumerate(stack):
                own = int(np.searchsorted(use, target))
                for q in np.flatnonzero(~seen[:, target]):
                    wide = np.zeros(size)
                    wide[np.append(use, MAX_MEMBERS)] = coef[i, q, :, own]
                    yield (*copy, name, int(sets[q]), wide, int(n[i]), bool(rest[i]))

    def solve(key, pdf, jobs):
        out, stacks = [], {}
        s = np.zeros((len(pdf), size, size))
        if len(pdf):
            s[:, upper[0], upper[1]] = np.stack(pdf["s"].to_numpy())
            s[:, upper[1], upper[0]] = s[:, upper[0], upper[1]]
        at = pdf.groupby(CLUSTER).indices
        for *cluster, sid, share, target in jobs[[*MASK, "pos"]].itertuples(index=False):
            mine = at.get(tuple(cluster), [])
            sets, seen, sums = _copy_sums(pdf.iloc[mine], s[mine], f"{sid}:{share}", target)
            # a series that is never known would be a row of zeros
            use = np.flatnonzero(seen.any(axis=0) | (np.arange(MAX_MEMBERS) == target))
            # copies with much more or fewer sets than others would be padded
            kind = (len(use), len(sets).bit_length())
            stack = stacks.setdefault(kind, [])
            stack.append(((*cluster, sid, share), target, use, sets, seen, sums))
            if len(stack) << kind[1] >= SETS:
                out += solve_stack(stacks.pop(kind))
        for stack in stacks.values():
            out += solve_stack(stack)
        return pd.DataFrame(out, columns=cols)

    total = cut_lineage(_set_sums(steps))
    # few bytes stand for much work: as many tasks as a shuffle has, which its bytes must not make fewer
    parts = int(total.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-total.count() // ROWS))
    deal = lambda df: df.withColumn("part", F.pmod(F.hash(*CLUSTER), F.lit(groups))).repartition(parts, "part").groupBy("part")
    jobs = masked.select(*MASK).distinct().join(place, [*CLUSTER, "series_id"])
    return deal(total).cogroup(deal(jobs)).applyInPandas(
        solve, "dataset string, cluster_id bigint, series_id bigint, miss_perc int, algorithm string, bits int, "
               "coef array<double>, rounds int, converged boolean")


def impute_low_rank_all(masked: DataFrame, cells: DataFrame, algorithms=ALGORITHMS, rounds: int = ROUNDS, tol: float = TOLERANCE) -> DataFrame:
    """Masked rows once per algorithm, with ``imputed``.

    ``cells`` has the series of each cluster (at most 15, else an error), the masked
    ones among them. A series without any known value is filled with zeros, and steps at
    which nothing is known with what the means lead to.
    """
    steps, masked, place = _inputs(masked, cells)
    fit = cut_lineage(_fit(steps, masked, place, list(algorithms), rounds, tol).drop("rounds", "converged"))
    rows = masked.join(place, [*CLUSTER, "series_id"]).join(steps, [*CLUSTER, "t"])
    rows = rows.withColumn("bits", _seen_bits()).withColumn(
        "algorithm", F.explode(F.array(*[F.lit(a) for a in algorithms])))
    done = rows.join(fit, [*MASK, "algorithm", "bits"], "left")
    guess = F.aggregate(F.zip_with("coef", "x", lambda c, x: c * x), F.lit(0.0), lambda s, e: s + e)
    known = ~F.col("hidden") & F.col("value").isNotNull()
    return done.select(*MASK, "t", "value", "hidden", "algorithm", F.when(known, F.col("value")).otherwise(guess).alias("imputed"))


def impute_low_rank(masked: DataFrame, cells: DataFrame, algorithm: str, rounds: int = ROUNDS, tol: float = TOLERANCE) -> DataFrame:
    """One of svdimp, softimp, svt, cdrec_k2 and cdrec_k3."""
    return impute_low_rank_all(masked, cells, (algorithm,), rounds, tol)

"""Correlation measures of pairs, clusters and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gapmend.functions.columns import SERIES, div
from gapmend.operators.series import series_to_array, znormalize

BLOCK = 256
# series up to this length are compared at all shifts by matrix products, longer ones by Fourier transforms
PRODUCT_STEPS = 256
# shifts of one product, columns and rows of one side in it; pairs below which transforms are faster
SHIFTS, COLUMNS, ROWS, FEW = 21, 512, 8, 64
# numbers that one batch of transforms holds
BATCH = 1 << 20


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cluster_arrays(df: DataFrame) -> DataFrame:
    """(dataset, cluster_id, series_id, vals)"""
    return series_to_array(df, ["dataset", "cluster_id", "series_id"])


def unit_arrays(df: DataFrame) -> DataFrame:
    """Arrays centred and scaled to length 1, so that a dot product is a correlation.

    NULL for constant series.
    """
    arr = cluster_arrays(df)
    mean = F.aggregate("vals", F.lit(0.0), lambda s, x: s + x) / F.size("vals")
    arr = arr.withColumn("mu", mean).withColumn("vals", F.transform("vals", lambda x: x - F.col("mu")))
    norm = F.sqrt(_dot(F.col("vals"), F.col("vals")))
    arr = arr.withColumn("norm", norm)
    return arr.select("dataset", "cluster_id", "series_id", F.when(
        F.col("norm") > 1e-9, F.transform("vals", lambda x: x / F.col("norm"))).alias("vals"))


def pairwise_series(arrays: DataFrame) -> DataFrame:
    """Unordered pairs of series inside a cluster (first id < second id).

    Meant for clusters bounded by ``explode_large_clusters``: with at most 15
    members the number of pairs stays linear in the number of series.
    """
    a = arrays.select("dataset", "cluster_id", F.col("series_id").alias("a"), F.col("vals").alias("va"))
    b = arrays.select("dataset", "cluster_id", F.col("series_id").alias("b"), F.col("vals").alias("vb"))
    return a.join(b, ["dataset", "cluster_id"]).where("a < b")


def pairwise_corr(df: DataFrame) -> DataFrame:
    """Pearson correlation of every pair inside a cluster: the strictly upper
    triangle of the cluster's correlation matrix. NULL when a side is constant."""
    p = pairwise_series(unit_arrays(df))
    return p.select("dataset", "cluster_id", "a", "b", _dot(F.col("va"), F.col("vb")).alias("corr"))


def mean_corr(df: DataFrame, keys=("dataset", "cluster_id")) -> DataFrame:
    """Mean pairwise correlation of a group, without forming pairs.

    With z-scored series, sum_ij r_ij = sum_t (sum_i z_it)^2 / m, so the mean over
    pairs needs only sums per (group, t). Groups of one score 1; a group with a
    constant series has no defined correlation (NULL).
    """
    keys = list(keys)
    z = znormalize(df)
    per_t = z.groupBy(*keys, "t").agg(
        F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.count("value").alias("n_ok"))
    agg = per_t.groupBy(*keys).agg(
        F.sum(F.col("s") * F.col("s")).alias("ss"), F.count(F.lit(1)).alias("m"), F.max("n").alias("n"),
        F.min("n_ok").alias("n_ok"))
    n = F.col("n").cast("double")
    return agg.select(*keys, F.col("n").alias("n_series"), F.when(F.col("n") == 1, 1.0).when(
        F.col("n_ok") == F.col("n"), (F.col("ss") / F.col("m") - n) / (n * (n - 1))).alias("mean_corr"))


def _ncc_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of row i of a with row i of b at all shifts."""
    m = a.shape[-1]
    size = 1 << (2 * m - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    cc = np.concatenate([cc[..., size - (m - 1):], cc[..., :m]], axis=-1)
    den = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    return np.where(den[..., None] > 0, cc / np.where(den > 0, den, 1.0)[..., None], 0.0)


def _length(n: int) -> int:
    """The least number from ``n`` on without prime factors above 5: transforms of such lengths are fast."""
    while True:
        rest = n
        for f in (2, 3, 5):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n
        n += 1


class Spectra:
    """Rows of equal length, scaled to length 1, for cross-correlations of many pairs. A constant zero row stays zero: it has correlation 0 with all others."""

    def __init__(self, rows, units: np.ndarray | None = None):
        self.rows = rows.astype(float, copy=False) if getattr(rows, "ndim", 1) == 2 else np.stack(rows).astype(float)
        self.m = self.rows.shape[1]
        self.size = _length(2 * self.m - 1)
        if units is None:
            norm = np.linalg.norm(self.rows, axis=1)
            units = self.rows * np.where(norm > 0, 1 / np.where(norm > 0, norm, 1.0), 0.0)[:, None]
        self.units, self.kept = units, {}

    def __len__(self):
        return len(self.rows)

    def part(self, which) -> Spectra:
        """Some of the rows."""
        out = Spectra(self.rows[which], self.units[which])
        if np.float32 in self.kept:
            out.kept[np.float32] = self.kept[np.float32][which]
        return out

    def as_kind(self, kind) -> np.ndarray:
        """The rows of length 1 in numbers of ``kind``, converted once."""
        if kind not in self.kept:
            self.kept[kind] = self.units.astype(kind, copy=False)
        return self.kept[kind]

    def freq(self, which: np.ndarray) -> np.ndarray:
        """Fourier transforms of the rows ``which``; those of a block of up to ``BATCH`` values are computed once."""
        if self.units.size > BATCH:
            return np.fft.rfft(self.units[which], self.size)
        if "freq" not in self.kept:
            self.kept["freq"] = np.fft.rfft(self.units, self.size)
        return self.kept["freq"][which]

    def pairs(self, i: np.ndarray, other: Spectra, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best correlation over all shifts of each row ``i`` with row ``j`` of another block, and that shift of row ``i``; of equal shifts the first from the left counts."""
        value, shift, m, size = np.zeros(len(i)), np.zeros(len(i), np.int64), self.m, self.size
        # a few hundred transforms at a time stay in the cache
        step = max(1, BATCH // 8 // size)
        for k in range(0, len(i), step):
            cross = np.conj(self.freq(i[k:k + step]))
            cross *= other.freq(j[k:k + step])
            cc = np.fft.irfft(cross, size)
            row, at = np.arange(len(cc)), cc[:, :m].argmax(axis=1)
            best = cc[row, at]
            if m > 1:
                back = cc[:, size - (m - 1):].argmax(axis=1) + size - (m - 1)
                far = cc[row, back]
                at, best = np.where(far >= best, back - size, at), np.maximum(far, best)
            value[k:k + step], shift[k:k + step] = best, at
        return value, shift

    def best(self, other: Spectra, kind=np.float64) -> np.ndarray:
        """Best correlation over all shifts of every row with every row of another block, in numbers of ``kind``."""
        if self.m > PRODUCT_STEPS or len(self) * len(other) < FEW:
            i, j = np.indices((len(self), len(other)))
            return self.pairs(i.ravel(), other, j.ravel())[0].reshape(i.shape).astype(kind)
        # the shorter side is laid out at all shifts, the longer one makes the columns
        if len(self) <= len(other):
            return _products(self.as_kind(kind), other.as_kind(kind))
        return np.ascontiguousarray(_products(other.as_kind(kind), self.as_kind(kind)).T)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest product of every row of ``a``, at any shift, with every row of ``b``. Shifts of similar size share the steps at which both rows can meet."""
    n, m = a.shape
    bt = np.ascontiguousarray(b.T)
    left, right = np.zeros((n, 2 * m), a.dtype), np.zeros((n, 2 * m), a.dtype)
    left[:, :m], right[:, m:] = a, a
    out = np.full((n, len(b)), -np.inf, a.dtype)
    for s in range(0, m, SHIFTS):
        end, width = min(s + SHIFTS, m), m - s
        moved = np.lib.stride_tricks.sliding_window_view(left, width, axis=1)[:, s:end]
        back = np.lib.stride_tricks.sliding_window_view(right, width, axis=1)[:, m - (end - 1) + s:m - max(s, 1) + s + 1]
        for windows, cells in ((moved, bt[:width]), (back, bt[s:])):
            if not windows.shape[1]:
                continue
            for i in range(0, n, ROWS):
                w = np.ascontiguousarray(windows[i:i + ROWS]).reshape(-1, width)
                for j in range(0, len(b), COLUMNS):
                    top = (w @ cells[:, j:j + COLUMNS]).reshape(-1, windows.shape[1], min(COLUMNS, len(b) - j)).max(axis=1)
                    np.maximum(out[i:i + ROWS, j:j + COLUMNS], top, out=out[i:i + ROWS, j:j + COLUMNS])
    return out


def ncc_pairs(pairs: DataFrame) -> DataFrame:
    """Cross-correlation of each pair (va, vb) at every shift in (-m, m): ``shifts``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = _ncc_rows(np.stack(pdf["va"].to_numpy()), np.stack(pdf["vb"].to_numpy()))
                yield pdf.drop(columns=["va", "vb"]).assign(shifts=list(m))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("va", "vb"))
    return pairs.mapInPandas(run, f"{head}, shifts array<double>")


def ncc_c(df: DataFrame) -> DataFrame:
    """(dataset, cluster_id, a, b, shift, ncc) for every pair and shift."""
    p = ncc_pairs(pairwise_series(cluster_arrays(df)))
    half = F.floor(F.size("shifts") / 2)
    return p.select("dataset", "cluster_id", "a", "b", half.alias("h"), F.posexplode("shifts").alias("k", "ncc")).select(
        "dataset", "cluster_id", "a", "b", (F.col("k") - F.col("h")).cast("bigint").alias("shift"), "ncc")


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], fn, schema: str, block: int = BLOCK) -> DataFrame:
    """Apply ``fn(key, left_rows, right_rows)`` to every pair of blocks with equal keys.

    Both sides are cut into blocks of about ``block`` rows per key, so a key with a
    third of all rows is many bounded tasks. A block is sent once per block of the
    other side; what ``fn`` returns should be aggregated or filtered, not all pairs.
    Rows carry ``bid``, the number that places them in a block.
    """
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    left, right = fresh(left), fresh(right)
    size = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias(n))
    n = size(left, "nl").join(size(right, "nr"), keys)
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    a = left.join(n, keys).withColumn("lb", F.pmod(F.hash("bid"), F.col("nl"))).withColumn("rb", spread("nr")).drop("nl", "nr")
    b = right.join(n, keys).withColumn("rb", F.pmod(F.hash("bid"), F.col("nr"))).withColumn("lb", spread("nl")).drop("nl", "nr")
    g = [*keys, "lb", "rb"]
    return a.groupBy(*g).cogroup(fresh(b).groupBy(*g)).applyInPandas(fn, schema)


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def mean_ncc(df: DataFrame, keys=("dataset", "cluster_id"), parts: int | None = None) -> DataFrame:
    """Mean over pairs of the best-shift cross-correlation; 1 for a single series.

    Pairs are formed between blocks of series; a task holds two blocks and returns one
    partial sum.
    """
    keys = list(keys)
    arr = series_to_array(df, [*keys, "series_id"])
    return mean_ncc_arrays(arr, keys, parts)


def vector_sums(rows: DataFrame, keys: list[str], col: str = "vals") -> DataFrame:
    """(keys, n, sums) of each group: the number of its vectors and their sum.

    Every Arrow batch is reduced to one vector per group before the shuffle, so a group with a third of
    all rows arrives as a few vectors.
    """
    head = f"{key_schema(rows, keys)}, n bigint, sums array<double>"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                code, first = pd.factorize(pd.MultiIndex.from_frame(pdf[keys]))
                x = np.stack(pdf[col].to_numpy()).astype(float)
                out = np.zeros((len(first), x.shape[1]))
                np.add.at(out, code, x)
                yield pd.DataFrame(list(first), columns=keys).assign(n=np.bincount(code), sums=list(out))

    def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, pdf["n"].sum(), np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]], columns=[*keys, "n", "sums"])

    return rows.select(*keys, col).mapInPandas(reduce, head).groupBy(*keys).applyInPandas(total, head)


def half_pairs(rows: DataFrame, keys: list[str], fn, schema: str, parts: int | None = None) -> DataFrame:
    """Apply ``fn(key, left_rows, right_rows)`` to every unordered pair of blocks with equal keys; the last two numbers of ``key`` name the blocks.

    ``rows`` carry ``bid`` and ``vals``. A key has some eight blocks, of ``BLOCK`` rows at least and of 16 times as many, or ``BATCH`` values, at most: a row is
    sent once per block, so larger groups have larger blocks. Few large groups want ``parts``, more partitions than a shuffle has, so that none gets many of their tasks.
    """
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    size = F.count(F.lit(1))
    block = F.least(F.greatest(F.ceil(size / 8), F.lit(BLOCK)), F.lit(16 * BLOCK), F.greatest(F.floor(F.lit(BATCH) / F.greatest(F.max(F.size("vals")), F.lit(1))), F.lit(1)))
    n = rows.groupBy(*keys).agg(F.ceil(size / block).cast("bigint").alias("nb"))
    at = rows.join(n, keys).withColumn("own", F.pmod(F.hash("bid"), F.col("nb")))
    a = at.withColumn("lb", F.col("own")).withColumn("rb", F.explode(F.sequence("own", F.col("nb") - 1))).drop("own", "nb")
    b = fresh(at).withColumn("rb", F.col("own")).withColumn("lb", F.explode(F.sequence(F.lit(0).cast("bigint"), "own"))).drop("own", "nb")
    g = [*keys, "lb", "rb"]
    a, b = (a, b) if parts is None else (a.repartition(parts, *g), b.repartition(parts, *g))
    return a.groupBy(*g).cogroup(b.groupBy(*g)).applyInPandas(fn, schema)


def pair_table(key, a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Best correlations of the rows of two blocks; inside one block only those with larger ids count, the others are 0."""
    best = Spectra(a["vals"].to_numpy()).best(Spectra(b["vals"].to_numpy()))
    if key[-2] == key[-1]:
        best = np.where(a["bid"].to_numpy()[:, None] < b["bid"].to_numpy()[None, :], best, 0.0)
    return best


def mean_ncc_arrays(arr: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    side = arr.select(*keys, F.col("series_id").alias("bid"), "vals")

    def score(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total, count = 0.0, 0
        if len(a) and len(b):
            # the best of all shifts is the same in both directions
            count = len(a) * (len(a) - 1) // 2 if key[-2] == key[-1] else len(a) * len(b)
            total = float(pair_table(key, a, b).sum()) if count else 0.0
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "total": [total], "pairs": [count]})

    sums = half_pairs(side, keys, score, f"{key_schema(arr, keys)}, total double, pairs bigint", parts)
    agg = sums.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return agg.select(*keys, F.coalesce(div("total", "pairs"), F.lit(1.0)).alias("mean_ncc"), "pairs")


def clustering_run_score(df: DataFrame) -> DataFrame:
    """Mean over the clusters of a data set of their mean cross-correlation."""
    return mean_ncc(df).groupBy("dataset").agg(
        F.avg("mean_ncc").alias("run_score"), F.count(F.lit(1)).alias("n_clusters"))


def centroid(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "cluster_id", "t").agg(F.avg("value").alias("value"))


def corr_summary(df: DataFrame) -> DataFrame:
    """Population standard deviation and median of the pair correlations."""
    return pairwise_corr(df).where("corr IS NOT NULL").groupBy("dataset", "cluster_id").agg(
        F.stddev_pop("corr").alias("std_corr"), F.expr("percentile(corr, 0.5)").alias("median_corr"),
        F.count(F.lit(1)).alias("n_pairs"))


def label_counts(df: DataFrame, col: str = "label") -> DataFrame:
    """Rows per label and their share. The share needs only the counts."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(total).select(col, "n", (F.col("n") / F.col("total")).alias("share"))


def feature_category_profile(features: DataFrame, meta: DataFrame, top: int = 5) -> DataFrame:
    """Mean of each feature per category, for the features that vary most between
    categories."""
    per = features.join(meta, "dataset").groupBy("category", "feature").agg(F.avg("value").alias("mean_value"))
    spread = per.groupBy("feature").agg(F.stddev_samp("mean_value").alias("spread"))
    best = spread.where("spread IS NOT NULL").orderBy(F.desc(F.round("spread", 9)), "feature").limit(top)
    return per.join(best, "feature")


def clustering_report(df: DataFrame) -> DataFrame:
    """Per data set: cross-correlation score, mean correlation, clusters and singletons."""
    corr = mean_corr(df).groupBy("dataset").agg(
        F.avg("mean_corr").alias("avg_corr"), F.count(F.lit(1)).alias("n_clusters"),
        F.count_if(F.col("n_series") == 1).alias("n_singletons"))
    return corr.join(clustering_run_score(df).select("dataset", "run_score"), "dataset")

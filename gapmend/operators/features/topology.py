"""Delay embedding, its principal components and the entropy of its components' birth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.operators.blocks import block_of, neighbours
from gapmend.operators.correlate import key_schema
from gapmend.operators.features.common import K, map_arrays, with_stats
from gapmend.session import cut_lineage

MAX_DELAY, MAX_DIM, STRIDE, MAX_PCA = 30, 50, 10, 3
#: Points of one series that one row holds while trees are grown.
POINTS = 256
UNDEFINED = -10.0


def _params(n: Column):
    delay = F.greatest(F.least(F.lit(MAX_DELAY), F.floor(n / 3)), F.lit(1)).cast("int")
    dim = F.greatest(F.least(F.lit(MAX_DIM), F.floor(n / delay)), F.lit(2)).cast("int")
    return delay, dim


def takens_embedding(df: DataFrame) -> DataFrame:
    """Points of the delay embedding: (dataset, series_id, point, coords).

    Point p starts at step p * STRIDE. Every step names the coordinates it is part of, so
    a group holds the coordinates of one point, never a series.
    """
    delay, dim = _params(F.col("n"))
    a = with_stats(df, n=F.count("t")).withColumn("delay", delay).withColumn("dim", dim)
    last = F.col("n") - 1 - (F.col("dim") - 1) * F.col("delay")
    start = lambda i: F.col("t") - i * F.col("delay")
    used = F.filter(F.sequence(F.lit(0), F.col("dim") - 1), lambda i: (start(i) >= 0) & (start(i) <= last) & (start(i) % STRIDE == 0))
    a = a.select(*K, "t", "value", "delay", F.explode(used).alias("i"))
    g = a.groupBy(*K, (start(F.col("i")) / STRIDE).cast("bigint").alias("point")).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("p"))
    return g.select(*K, "point", F.transform("p", lambda q: q["value"]).alias("coords"))


def _scatter(batches):
    """Partial sums per series and batch: the products of centred coordinates, then the number of points."""
    for pdf in batches:
        out = []
        for key, part in pdf.groupby(K, sort=False):
            c = np.array(part.c.tolist(), dtype=float)
            out.append((*key, np.r_[(c.T @ c).ravel(), len(c)]))
        yield pd.DataFrame(out, columns=[*K, "s"])


def _axes(sums: np.ndarray) -> np.ndarray:
    """Up to MAX_PCA principal axes, one after the other, from summed products and the number of points."""
    d = int(round(np.sqrt(len(sums) - 1)))
    _, vec = np.linalg.eigh(sums[:-1].reshape(d, d))
    axes = vec[:, ::-1][:, :min(MAX_PCA, d, int(sums[-1]))].T
    # the sign of an axis is free: make its largest entry positive
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return (axes * np.where(sign == 0, 1, sign)[:, None]).ravel()


def embedding_pca(points: DataFrame) -> DataFrame:
    """Each series' points on up to three principal components of those points.

    Means and products of coordinates are summed over the points; a task solves one matrix
    of at most MAX_DIM rows per series, and the projection is a product of columns.
    """
    mean = points.select(*K, F.posexplode("coords").alias("i", "v")).groupBy(*K, "i").agg(F.avg("v").alias("v"))
    mean = mean.groupBy(*K).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda q: q["v"]).alias("mu"))
    c = points.join(mean, K).select(*K, "point", F.zip_with("coords", "mu", lambda x, m: x - m).alias("c"))
    parts = c.select(*K, "c").mapInPandas(_scatter, f"{key_schema(c, K)}, s array<double>")
    sums = parts.select(*K, F.posexplode("s").alias("i", "v")).groupBy(*K, "i").agg(F.sum("v").alias("v"))
    sums = sums.groupBy(*K).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda q: q["v"]).alias("s"))
    axes = map_arrays(sums, "axes", _axes, "s").select(*K, "axes")
    d = F.size("c")
    along = lambda j: F.aggregate(F.zip_with("c", F.slice("axes", j * d + 1, d), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return c.join(axes, K).select(*K, "point", F.transform(F.sequence(F.lit(0), (F.size("axes") / d).cast("int") - 1), along).alias("coords"))


def _tree(p: np.ndarray):
    """(from, to, length) of the edges of a minimum spanning tree of the points."""
    n = len(p)
    near, source = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, dtype=bool)
    cur, out = 0, []
    for _ in range(n - 1):
        left[cur] = False
        d = np.sqrt(((p - p[cur]) ** 2).sum(axis=1))
        source = np.where(d < near, cur, source)
        near = np.minimum(near, d)
        cur = int(np.argmin(np.where(left, near, np.inf)))
        out.append((source[cur], cur, near[cur]))
    return out


def _tree_edges(points: DataFrame) -> DataFrame:
    """Edges (dataset, series_id, u, v, w, blocks) that hold a minimum spanning tree of each series' points.

    A tree of every block, and the edges between two blocks that a tree of both together has: below any
    length these connect what all edges connect. The walk from point to point connects two blocks by hops
    no longer than the longest one between them, so blocks whose boxes are further apart are not compared.
    """
    steps = POINTS
    hop = F.sqrt(F.aggregate(F.zip_with("coords", "prev", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    walk = neighbours(points, {"prev": lambda w: F.lag("coords").over(w)}, before=1, keys=K, order="point", steps=steps)
    b = walk.groupBy(*K, block_of("point", steps).alias("blk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("point", "coords"))), lambda q: q["coords"]).alias("p"), F.max(hop).alias("hop"))
    side = lambda pick: F.aggregate("p", F.col("p")[0], lambda a, x: F.zip_with(a, x, lambda p, q: pick(p, q)))
    b = cut_lineage(b.select(*K, "blk", F.size(F.col("p")[0]).alias("dim"), F.flatten("p").alias("p"), "hop",
                             side(F.least).alias("lo"), side(F.greatest).alias("hi")))

    box = lambda n: b.select(*K, F.col("blk").alias(n), F.col("hop").alias(f"hop_{n}"), F.struct("lo", "hi").alias(f"box_{n}"))
    pairs = box("i").join(box("j"), K).where(F.col("i") <= F.col("j"))
    reach = F.max("hop_j").over(W.partitionBy(*K, "i").orderBy("j"))
    apart = lambda a, z: F.zip_with(F.col(f"box_{a}")["lo"], F.col(f"box_{z}")["hi"], lambda x, y: F.greatest(x - y, F.lit(0.0)))
    gap = F.sqrt(F.aggregate(F.zip_with(apart("i", "j"), apart("j", "i"), lambda x, y: x * x + y * y), F.lit(0.0), lambda s, x: s + x))
    pairs = pairs.select(*K, "i", "j", reach.alias("reach"), gap.alias("gap")).where((F.col("i") == F.col("j")) | (F.col("gap") <= F.col("reach") * (1 + 1e-9)))
    part = lambda n: b.select(*K, F.col("blk").alias(n), F.col("p").alias(f"p_{n}"), "dim")
    rows = pairs.select(*K, "i", "j").join(part("i"), [*K, "i"]).join(part("j").drop("dim"), [*K, "j"])
    count = b.groupBy(*K).agg(F.count(F.lit(1)).alias("blocks"))

    def grow(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, z = (np.asarray(x, dtype=float).reshape(-1, r.dim) for x in (r.p_i, r.p_j))
                if r.i == r.j:
                    out = _tree(a)
                else:
                    out = [(u, v, w) for u, v, w in _tree(np.concatenate([a, z])) if (u < len(a)) != (v < len(a))]
                # places in the two blocks, one after the other, to numbers of points
                num = lambda x: r.i * steps + x if x < len(a) else r.j * steps + x - len(a)  # noqa: E731, B023
                if out:
                    u, v, w = zip(*out)
                    u, v = [num(x) for x in u], [num(x) for x in v]
                    yield pd.DataFrame({K[0]: getattr(r, K[0]), K[1]: getattr(r, K[1]), "u": np.minimum(u, v), "v": np.maximum(u, v), "w": w})
    edges = rows.mapInPandas(grow, f"{key_schema(points, K)}, u bigint, v bigint, w double")
    return edges.join(count, K)


def _spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (dataset, series_id, u, v, w) of the minimum spanning tree of each series' edges.

    Rounds: every component takes its least edge (by length, then ends), components joined by
    these become one, edges inside a component go, and of several edges between two the least stays.
    A round at least halves the components.
    """
    live = cut_lineage(edges.select(*K, F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e")))
    tree = live.select(*K, "e").limit(0)
    while not live.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("x")
        best = live.select(*K, "e", ends).groupBy(*K, F.col("x.c").alias("c")).agg(F.min(F.struct("e", "x.o")).alias("m"))
        best = cut_lineage(best.select(*K, "c", F.col("m.o").alias("up"), "m.e"))
        tree = cut_lineage(tree.unionAll(best.select(*K, "e").distinct()))
        # two components that chose each other: the smaller number stands for both
        back = best.select(*K, F.col("c").alias("up"), F.col("up").alias("back"))
        own = (F.col("back") == F.col("c")) & (F.col("c") < F.col("up"))
        heads = cut_lineage(best.join(back, [*K, "up"]).select(*K, "c", F.when(own, F.col("c")).otherwise(F.col("up")).alias("up")))
        while True:
            above = heads.select(*K, F.col("c").alias("up"), F.col("up").alias("top"))
            after = cut_lineage(heads.join(above, [*K, "up"]).select(*K, "c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            heads = after.select(*K, "c", "up")
            if after.where("moved").isEmpty():
                break
        head = lambda n: heads.select(*K, F.col("c").alias(n), F.col("up").alias(f"{n}_up"))
        joined = live.join(head("a"), [*K, "a"]).join(head("b"), [*K, "b"]).where("a_up <> b_up")
        live = cut_lineage(joined.groupBy(*K, F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).agg(F.min("e").alias("e")))
    return tree.select(*K, "e.u", "e.v", "e.w")


def spanning_tree(points: DataFrame) -> DataFrame:
    """(dataset, series_id, u, v, w): edges of a minimum spanning tree of each series' points.

    The points of a series are numbered from 0 without gaps. The tree of a series of one block is
    ready after the first step; longer ones are joined in rounds. Pairs of blocks that are near each
    other are compared, so a series whose blocks all overlap costs work by the square of its points.
    """
    edges = cut_lineage(_tree_edges(points))
    cols = [*K, "u", "v", "w"]
    return edges.where("blocks = 1").select(cols).unionAll(_spanning_forest(edges.where("blocks > 1")))


def persistence_entropy_h0(points: DataFrame) -> DataFrame:
    """Normalised entropy of the lifetimes of connected components (H0).

    The lifetimes are the edge lengths of the minimum spanning tree of a series'
    points, of which there is one per STRIDE steps.
    """
    points = cut_lineage(points)
    life = spanning_tree(points).where("w > 0").groupBy(*K).agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.log2("w")).alias("s"))
    e = points.where("point = 0").select(*K).join(life, K, "left")
    norm = F.log2("total")
    # the sum of -w/total * log2(w/total)
    ent = F.greatest(norm - F.col("s") / F.col("total"), F.lit(0.0))
    return e.select(*K, F.lit("persistence_entropy_h0").alias("feature"), F.coalesce(ent / F.nullif(norm, F.lit(0.0)), F.lit(UNDEFINED)).alias("value"))


def topology(df: DataFrame) -> DataFrame:
    return persistence_entropy_h0(embedding_pca(takens_embedding(df)))

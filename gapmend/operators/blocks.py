"""Order-dependent work on series without putting a whole series in one task.

A series is cut into blocks of ``STEPS`` consecutive time steps. Frames of finite
width see their neighbours through a halo of copied edge rows; running totals and
carried values are computed inside each block and joined with one summary row per
block. Every window is therefore partitioned by (series, block), whatever the
length of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gapmend.functions.columns import SERIES, as_col
from gapmend.session import cut_lineage

STEPS = 4096
#: Rows of one range where rows are numbered by ranges.
RANGE_ROWS = 1 << 20


def block_of(order: str = "t", steps: int | None = None) -> Column:
    return F.floor(F.col(order) / (steps or STEPS)).cast("bigint")


def with_halo(df: DataFrame, before: int = 0, after: int = 0, order: str = "t",
              steps: int | None = None) -> DataFrame:
    """Add ``blk`` and ``own``; edge rows are copied into neighbouring blocks.

    After the windows are evaluated, keep only rows with ``own``.
    """
    steps = steps or STEPS
    if before > steps or after > steps:
        raise ValueError("halo wider than a block")
    lo = F.greatest(F.lit(0), F.floor((F.col(order) - after) / steps)).cast("bigint")
    hi = F.floor((F.col(order) + before) / steps).cast("bigint")
    out = df.withColumn("blk", F.explode(F.sequence(lo, hi)))
    return out.withColumn("own", F.col("blk") == block_of(order, steps))


def in_block(keys=SERIES, order: str = "t"):
    return W.partitionBy(*keys, "blk").orderBy(order)


def neighbours(df: DataFrame, exprs: dict, before: int = 0, after: int = 0, keys=SERIES,
               order: str = "t", steps: int | None = None) -> DataFrame:
    """Evaluate finite-frame window expressions; ``exprs[name](window)`` -> Column."""
    w = in_block(keys, order)
    out = with_halo(df, before, after, order, steps)
    out = out.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
    return out.where("own").drop("own", "blk")


def prefix_sums(df: DataFrame, cols: dict, keys=SERIES, order: str = "t",
                steps: int | None = None) -> DataFrame:
    """Inclusive running sums along ``order``, as new columns."""
    base = df.withColumn("blk", block_of(order, steps))
    run = in_block(keys, order).rowsBetween(W.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(as_col(c)).over(run).alias(f"{n}__in") for n, c in cols.items()])
    totals = base.groupBy(*keys, "blk").agg(*[F.sum(as_col(c)).alias(f"{n}__all") for n, c in cols.items()])
    earlier = W.partitionBy(*keys).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "blk", *[
        F.coalesce(F.sum(f"{n}__all").over(earlier), F.lit(0)).alias(f"{n}__off") for n in cols])
    out = local.join(offsets, [*keys, "blk"])
    for n in cols:
        out = out.withColumn(n, F.coalesce(F.col(f"{n}__in"), F.lit(0)) + F.col(f"{n}__off"))
    return out.drop("blk", *[f"{n}__{s}" for n in cols for s in ("in", "off")])


def carry(df: DataFrame, value: str, keys=SERIES, order: str = "t", steps: int | None = None,
          extra: dict | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """Nearest known point at or before (``prev``) and at or after (``next``) each row.

    Both are structs (t, v), NULL where there is none. ``extra`` adds finite-frame
    expressions (see ``neighbours``) that share the sort of the blocks.
    """
    point = F.when(F.col(value).isNotNull(),
                   F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    w = in_block(keys, order)
    base = with_halo(df, before, after, order, steps)
    local = base.select(
        "*", *[fn(w).alias(name) for name, fn in (extra or {}).items()],
        F.last(point, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("prev_in"),
        F.first(point, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("next_in"))
    local = local.where("own")
    ends = df.withColumn("blk", block_of(order, steps)).groupBy(*keys, "blk").agg(
        F.max(point).alias("last_pt"), F.min(point).alias("first_pt"))
    wb = W.partitionBy(*keys).orderBy("blk")
    ends = ends.select(
        *keys, "blk",
        F.last("last_pt", ignorenulls=True).over(wb.rowsBetween(W.unboundedPreceding, -1)).alias("prev_out"),
        F.first("first_pt", ignorenulls=True).over(wb.rowsBetween(1, W.unboundedFollowing)).alias("next_out"))
    out = local.join(ends, [*keys, "blk"])
    return out.select(
        *df.columns, *(extra or {}),
        F.coalesce("prev_in", "prev_out").alias("prev"),
        F.coalesce("next_in", "next_out").alias("next"))


def runs(df: DataFrame, flag: Column, keys=SERIES, order: str = "t") -> DataFrame:
    """Maximal runs of equal ``flag``: one row (keys, flag, run, length)."""
    marked = neighbours(df.withColumn("flag", flag), {
        "edge": lambda w: (F.coalesce(F.col("flag") != F.lag("flag").over(w), F.lit(True))).cast("bigint")},
        before=1, keys=keys, order=order)
    numbered = prefix_sums(marked, {"run": "edge"}, keys, order)
    return numbered.groupBy(*keys, "run").agg(
        F.first("flag").alias("flag"), F.count(F.lit(1)).alias("length"))


def ranked(df: DataFrame, part: list[str], order: list, bucket: Column, name: str = "rn") -> DataFrame:
    """Exact ``row_number`` in ``part`` when one part may hold much of the table.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside
    (part, bucket); one row per bucket carries the count of earlier buckets.
    """
    base = df.withColumn("bkt", bucket)
    keys = [*part, "bkt"]
    local = base.withColumn("rn_in", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    # with no partition columns a constant keeps Spark from warning; the table is small
    wb = W.partitionBy(*(part or [F.lit(0)])).orderBy("bkt")
    sizes = sizes.select(*keys, F.coalesce(
        F.sum("cnt").over(wb.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = local.join(sizes, keys)
    return out.withColumn(name, (F.col("rn_in") + F.col("before")).cast("bigint")).drop(
        "bkt", "rn_in", "before")


def numbered(df: DataFrame, part: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Exact ``row_number`` in ``part`` along ``order``, whatever the values are.

    Spark samples splitters and cuts the table into ranges of about RANGE_ROWS rows; rows are numbered
    inside (part, range) and one row per range carries the count before it. The ranges are written once, as
    the number of a range holds for one layout only. Rows that tie in all columns stay in one range.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    base = cut_lineage(df.repartitionByRange(ranges, *part, *order).withColumn("rng", F.spark_partition_id()))
    keys = [*part, "rng"]
    local = base.withColumn("rn_in", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    wb = W.partitionBy(*(part or [F.lit(0)])).orderBy("rng")
    sizes = sizes.select(*keys, F.coalesce(F.sum("cnt").over(wb.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = local.join(sizes, keys)
    return out.withColumn(name, (F.col("rn_in") + F.col("before")).cast("bigint")).drop("rng", "rn_in", "before")

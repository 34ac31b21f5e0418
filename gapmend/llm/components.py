"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapmend.llm.common import staged


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node reachable.

    Large-star and small-star steps in turn until nothing changes; the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder. Minima combine
    before their shuffle, and a small table of minima is broadcast by Spark's own size check, so a
    node with very many edges is no hot key. No edges give no rows.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")
        small = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        moved = large.join(small, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = staged(moved.select("x.*").where("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

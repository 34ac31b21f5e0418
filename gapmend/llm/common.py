"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapmend.session import scratch_path

#: White space that separates words: blank and \x09-\x0D.
BLANKS = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable over a one-element array."""
    return F.transform(F.array(value), body).getItem(0)


def word_windows(hashed: Column, n: int) -> Column:
    """64-bit hashes of the runs of ``n`` consecutive items of an array; empty if it is shorter."""
    last = F.size(hashed) - n
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(n)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def running_sums(values: Column, block: int = 128) -> Column:
    """Prefix sums (each with its own item) of an array of longs, in blocks, so that long arrays
    cost n * block and not n * n."""
    n = F.size(values)

    def total(a):
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def inside(b, base):
        return F.transform(b, lambda x, i: base + total(F.slice(b, 1, i + 1)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                         lambda q: F.slice(values, q * block + 1, block))
    out = let(blocks, lambda bs: let(F.transform(bs, total), lambda ts: F.flatten(
        F.transform(bs, lambda b, q: inside(b, F.when(q > 0, total(F.slice(ts, 1, F.greatest(q, F.lit(1)))))
                                            .otherwise(F.lit(0).cast("bigint")))))))
    return F.when(n > 0, out).otherwise(F.array().cast("array<bigint>"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps and lost executors
    read the files instead of computing it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for look-up tables that are
    dear to build. Callers bound its size."""
    import sys
    import types

    m = sys.modules.setdefault("gapmend_worker_cache", types.ModuleType("gapmend_worker_cache"))
    return m.__dict__.setdefault(name, {})


def drop_worker_caches() -> None:
    """Forgets the look-up tables of other operators: an operator that needs its worker's memory for
    itself calls this where its work begins."""
    import sys

    m = sys.modules.get("gapmend_worker_cache")
    if m is not None:
        for name in [n for n, x in vars(m).items() if isinstance(x, dict) and not n.startswith("__")]:
            delattr(m, name)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside sends at most so many rows in an Arrow batch: whole texts are long, and an
    executor holds batches outside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

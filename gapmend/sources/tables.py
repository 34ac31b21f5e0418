"""Series from tables, and the time index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapmend.functions.columns import as_col


def month_step(ts, start_year: int) -> Column:
    """Months since January of ``start_year``."""
    c = as_col(ts)
    return ((F.year(c) - start_year) * 12 + F.month(c) - 1).cast("bigint")


def day_step(ts, start: str) -> Column:
    return F.datediff(as_col(ts), F.lit(start).cast("date")).cast("bigint")


def series_from_table(df: DataFrame, key, step: Column, value: Column, fill: float | None = None,
                      span: tuple[int, int] | None = None) -> DataFrame:
    """One dense series per key: ``(series_id, t, value)`` for every step from the first to the last
    one of the table, or of ``span`` (both included; rows outside it are left out).

    ``step`` maps a row to its bucket and ``value`` is an aggregate. Cells without
    rows are NULL (a gap) or ``fill``; rows without a step are left out. Rows are pre-aggregated
    map-side, so a key with most of the rows costs no more than its steps per task. A series' cells are
    sorted once and the gaps between neighbours filled, so the work is linear in its length.
    """
    lo, hi = span or df.agg(F.min(step), F.max(step)).first()
    lo, hi = (0, -1) if lo is None else (lo, hi)
    cells = (df.select(as_col(key).cast("bigint").alias("series_id"), step.cast("bigint").alias("t"), "*")
             .where(F.col("t").between(lo, hi))
             .groupBy("series_id", "t").agg(value.cast("double").alias("value")))
    gap = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    packed = cells.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("c"))
    after = lambda i: F.coalesce(F.get("c", i + 1)["t"], F.lit(hi + 1))
    filled = F.flatten(F.transform("c", lambda x, i: F.concat(F.array(x["value"]), gap(after(i) - x["t"] - 1))))
    whole = F.concat(gap(F.get("c", F.lit(0))["t"] - lo), filled)
    out = packed.select("series_id", F.posexplode(whole).alias("t", "value")).select(
        "series_id", (F.col("t") + lo).cast("bigint").alias("t"), "value")
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(float(fill))))


def series_from_arrays(df: DataFrame, key, values) -> DataFrame:
    """Explode an array column into ``(series_id, t, value)``."""
    return df.select(as_col(key).cast("bigint").alias("series_id"),
                     F.posexplode(as_col(values)).alias("t", "value")).select(
        "series_id", F.col("t").cast("bigint").alias("t"), F.col("value").cast("double").alias("value"))


def all_datetimes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key: does every value of ``text`` parse as a timestamp?"""
    return df.groupBy(*keys).agg(
        F.bool_and(F.try_to_timestamp(F.col(text)).isNotNull()).alias("is_datetime"))


def resolve_time_index(df: DataFrame, first_column: str = "ts_text", index_file: str = "index_ts",
                       info_start: str = "start_ts", info_seconds: str = "freq_seconds") -> DataFrame:
    """Add ``ts``: datetime column, else index file, else start + t * freq, else
    1900-01-01 + t seconds. Columns that do not apply to a data set are NULL."""
    step = F.make_interval(secs=(F.col("t") * F.coalesce(F.col(info_seconds), F.lit(1))).cast("decimal(18,6)"))
    start = F.coalesce(F.col(info_start), F.lit("1900-01-01 00:00:00").cast("timestamp_ntz"))
    return df.withColumn("ts", F.coalesce(
        F.try_to_timestamp(F.col(first_column)).cast("timestamp_ntz"),
        F.col(index_file), start + step))


def dataset_filter(df: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Keep the listed data sets (all when ``wanted`` is None)."""
    return df if wanted is None else df.join(wanted.select("dataset").distinct(), "dataset", "left_semi")


def missing_datasets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listed data sets that have no rows; the caller fails when there are any."""
    return wanted.select("dataset").distinct().join(
        df.select("dataset").distinct(), "dataset", "left_anti")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Number of series, length and complexity (their product) per data set."""
    per_series = df.groupBy("dataset", "series_id").agg(
        F.count(F.lit(1)).alias("n"))
    return per_series.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_series"), F.max("n").alias("length")).withColumn(
        "complexity", F.col("n_series") * F.col("length"))

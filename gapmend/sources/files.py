"""Text files in the layouts the recommender reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gapmend.operators.blocks import ranked


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or more files with a dense line number per file.

    ``monotonically_increasing_id`` keeps the order of the splits of a file; its
    upper bits (the split) serve as bucket, so no task sees more than one split.
    """
    raw = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"), "value")
    split = F.shiftright(F.col("pos"), 33)
    return ranked(raw.where(F.trim("value") != ""), ["file"], ["pos"], split, "line").withColumn(
        "line", F.col("line") - 1)


def _fields(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")


def read_series_wide(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Space separated, no header, one column per series, one line per time step.

    A first column that is a datetime on every line becomes ``ts``.
    """
    lines = _numbered_lines(spark, path).select("file", F.col("line").alias("t"), _fields(F.col("value")).alias("f"))
    dated = lines.groupBy("file").agg(F.bool_and(
        F.col("f")[0].rlike(r"^\d{4}-\d{1,2}-\d{1,2}")).alias("dated"))
    lines = lines.join(dated, "file")
    # a datetime with a clock part takes two fields
    width = F.when(~F.col("dated"), 0).when(F.col("f")[1].rlike(r"^\d{1,2}:\d{2}"), 2).otherwise(1)
    stamp = F.when(width == 0, None).when(
        width == 1, F.col("f")[0]).otherwise(F.concat_ws(" ", F.col("f")[0], F.col("f")[1]))
    body = lines.select("t", F.try_to_timestamp(stamp).alias("ts"),
                        F.expr("slice(f, 1 + CASE WHEN NOT dated THEN 0 WHEN f[1] RLIKE "
                               "'^[0-9]{1,2}:[0-9]{2}' THEN 2 ELSE 1 END, size(f))").alias("f"))
    return body.select(F.lit(dataset).alias("dataset"), "t", "ts", F.posexplode("f").alias("series_id", "x")).select(
        "dataset", F.col("series_id").cast("bigint"), "t", "ts",
        F.nullif(F.expr("try_cast(x AS double)"), F.lit(float("nan"))).alias("value"))


def read_series_rows(spark: SparkSession, path: str, dataset: str = "input") -> DataFrame:
    """Recommendation input: one line is one series.

    Series are numbered over all files of the path, in file name order.
    """
    lines = _numbered_lines(spark, path)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("cnt"))
    starts = sizes.select("file", F.coalesce(F.sum("cnt").over(
        W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    lines = lines.join(starts, "file")
    return lines.select(
        F.lit(dataset).alias("dataset"), (F.col("line") + F.col("start")).alias("series_id"),
        F.posexplode(_fields(F.col("value"))).alias("t", "x")).select(
        "dataset", "series_id", F.col("t").cast("bigint"),
        F.nullif(F.expr("try_cast(x AS double)"), F.lit(float("nan"))).alias("value"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index file: one datetime per line -> (t, index_ts)."""
    return _numbered_lines(spark, path).select(
        F.col("line").alias("t"), F.try_to_timestamp(F.trim("value")).alias("index_ts"))


def write_recommendations(df: DataFrame, path: str) -> None:
    """Space separated with a header; one row per series, one column per class."""
    df.write.mode("overwrite").option("sep", " ").option("header", True).csv(path)

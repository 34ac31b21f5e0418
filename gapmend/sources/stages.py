"""Stage tables: one Parquet partition per data set, written once and reused."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapmend.operators.models import Model


def persist_stage(df: DataFrame, root: str, stage: str) -> None:
    """Write a stage; only the data sets present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset").parquet(f"{root}/{stage}"))


def load_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stage}")


def _stage_present(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage_missing(wanted: DataFrame, root: str, stage: str) -> DataFrame:
    """Data sets of ``wanted`` that the stage table does not hold yet."""
    spark = wanted.sparkSession
    names = wanted.select("dataset").distinct()
    if not _stage_present(spark, f"{root}/{stage}"):
        return names
    have = load_stage(spark, root, stage).select("dataset").distinct()
    return names.join(have, "dataset", "left_anti")


def run_stage(df: DataFrame, root: str, stage: str, build) -> DataFrame:
    """Compute ``build(rows)`` for the data sets the stage lacks, then read it back."""
    todo = stage_missing(df, root, stage)
    if not todo.isEmpty():
        persist_stage(build(df.join(todo, "dataset", "left_semi")), root, stage)
    return load_stage(df.sparkSession, root, stage)


def save_run(root: str, models: dict[str, Model], train: DataFrame, test: DataFrame,
             manifest: dict) -> None:
    """Save a training run: whole models with their steps, of any classifier, the train and test tables and a JSON manifest."""
    spark = train.sparkSession
    for name, model in models.items():
        model.save(spark, f"{root}/models/{name}")
    train.write.mode("overwrite").parquet(f"{root}/train")
    test.write.mode("overwrite").parquet(f"{root}/test")
    text = json.dumps({**manifest, "models": sorted(models)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")


def load_run(spark: SparkSession, root: str):
    """-> (models by name, train, test, manifest)"""
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()["value"])
    models = {m: Model.load(spark, f"{root}/models/{m}") for m in manifest["models"]}
    return models, spark.read.parquet(f"{root}/train"), spark.read.parquet(f"{root}/test"), manifest


def info_set(train: DataFrame, test: DataFrame, models: list[str], features: list[str]) -> DataFrame:
    """The small description of a run: sizes, labels, features and models."""
    spark = train.sparkSession

    def side(df, name):
        return df.agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct("dataset").alias("n_datasets"),
                      F.array_sort(F.collect_set("label")).alias("labels")).select(F.lit(name).alias("split"), "*")

    return side(train, "train").unionByName(side(test, "test")).withColumn(
        "models", F.lit(",".join(models))).withColumn("features", F.lit(",".join(features)))

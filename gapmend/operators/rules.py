"""Rule-based labels from binary cluster traits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

TRAITS = ["large_ts", "irregular_ts", "mixed_corr", "high_corr"]
BASE_WEIGHT = 0.25
# fixed values: strength of each technique (efficient, large, irregular, mixed, high correlation)
STRENGTHS = [
    ("cdrec", 1, 3, 3, 5, 3),
    ("dynammo", 0, 0, 5, 4, 3),
    ("softimp", 1, 3, 4, 3, 2),
    ("svdimp", 1, 4, 3, 4, 3),
    ("stmvl", 0, 2, 2, 1, 5),
    ("trmf", 0, 1, 3, 4, 3),
]


def rules_ranking(traits: DataFrame) -> DataFrame:
    """All techniques of each cluster by score; equal scores keep the table order."""
    rows = F.array(*[F.struct(
        F.lit(i).alias("pos"), F.lit(name).alias("algorithm"),
        (F.lit(BASE_WEIGHT * eff) + sum((F.col(t) * F.lit(float(s)) for t, s in zip(TRAITS, strong)), F.lit(0.0))).alias("score"))
        for i, (name, eff, *strong) in enumerate(STRENGTHS)])
    out = traits.select("dataset", "cluster_id", F.explode(rows).alias("r")).select("dataset", "cluster_id", "r.*")
    w = W.partitionBy("dataset", "cluster_id").orderBy(F.desc("score"), "pos")
    return out.withColumn("rank", F.row_number().over(w)).drop("pos")


def rules_label(traits: DataFrame) -> DataFrame:
    return rules_ranking(traits).where("rank = 1").select("dataset", "cluster_id", F.col("algorithm").alias("label"))

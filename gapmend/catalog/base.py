"""Query registry and the series that queries run on, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapmend.functions.columns import r6
from gapmend.operators.series import explode_large_clusters
from gapmend.sources.tables import day_step, month_step, series_from_arrays, series_from_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

START_YEAR, MONTHS = 1995, 83
START_DAY = "2024-01-01"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def nations(spark, d) -> DataFrame:
    """(series_id, dataset, cluster_id): a supplier belongs to its nation."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("series_id"), F.col("n_name").alias("dataset"),
        F.col("n_nationkey").cast("bigint").alias("cluster_id"))


def supplier_month(spark, d, fill: float | None = 0.0) -> DataFrame:
    """Quantity shipped per supplier and month: (dataset, series_id, t, value)."""
    li = table(spark, d, "lineitem")
    s = series_from_table(li, "l_suppkey", month_step("l_shipdate", START_YEAR), F.sum("l_quantity"), fill)
    return s.join(nations(spark, d).drop("cluster_id"), "series_id").select("dataset", "series_id", "t", "value")


def assignment(spark, d) -> DataFrame:
    """Suppliers grouped by nation, in groups of at most 15."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series_id")).distinct()
    return explode_large_clusters(nations(spark, d).join(li, "series_id", "left_semi"))


def clustered_month(spark, d, fill: float | None = 0.0) -> DataFrame:
    """supplier_month with cluster_id."""
    return supplier_month(spark, d, fill).join(assignment(spark, d), ["dataset", "series_id"])


def user_day(spark, d) -> DataFrame:
    """Mean event value per user and day, with natural gaps."""
    ev = table(spark, d, "events")
    s = series_from_table(ev, "user_id", day_step("ts", START_DAY), F.avg("value"))
    return s.select(F.lit("events").alias("dataset"), "series_id", "t", "value")


def embedding_series(spark, d) -> DataFrame:
    """One dense series of 64 steps per embedding, grouped by its label."""
    e = table(spark, d, "embeddings")
    s = series_from_arrays(e, "vec_id", "embedding")
    lab = e.select(F.col("vec_id").alias("series_id"), F.col("label").cast("bigint").alias("cluster_id"))
    return s.join(lab, "series_id").select(
        F.lit("embeddings").alias("dataset"), "series_id", "cluster_id", "t", "value")


# --- the same series for the SQL side ----------------------------------------------

_CELLS = f"""cells AS (
  SELECT l_suppkey AS series_id, (year(l_shipdate)-{START_YEAR})*12+month(l_shipdate)-1 AS t, sum(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2),
nat AS (SELECT s_suppkey AS series_id, n_name AS dataset, n_nationkey::BIGINT AS cluster_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ids AS (SELECT DISTINCT series_id FROM cells),
grid AS (SELECT series_id, t FROM ids CROSS JOIN (SELECT unnest(range((SELECT min(t) FROM cells), (SELECT max(t) + 1 FROM cells))) AS t))"""

SM = f"""{_CELLS},
sm AS (SELECT dataset, g.series_id, g.t, coalesce(v, 0.0) AS value
  FROM grid g LEFT JOIN cells c ON c.series_id = g.series_id AND c.t = g.t JOIN nat ON nat.series_id = g.series_id)"""

SM_GAPS = f"""{_CELLS},
sm AS (SELECT dataset, g.series_id, g.t, v AS value
  FROM grid g LEFT JOIN cells c ON c.series_id = g.series_id AND c.t = g.t JOIN nat ON nat.series_id = g.series_id)"""

ASG = """asg AS (SELECT dataset, series_id,
  cluster_id + (chunk - 1) * (max(cluster_id) OVER (PARTITION BY dataset) + 1) AS cluster_id
  FROM (SELECT *, CASE WHEN n <= 15 THEN 1 ELSE
      CASE WHEN pos - 1 < ex * (ea + 1) THEN (pos - 1) // (ea + 1) ELSE ex + (pos - 1 - ex * (ea + 1)) // ea END + 1 END AS chunk
    FROM (SELECT *, n // parts AS ea, n - (n // parts) * parts AS ex
      FROM (SELECT *, ceil(n / 15.0)::BIGINT AS parts
        FROM (SELECT nat.dataset, nat.series_id, nat.cluster_id,
          count(*) OVER (PARTITION BY nat.dataset, nat.cluster_id) AS n,
          row_number() OVER (PARTITION BY nat.dataset, nat.cluster_id ORDER BY nat.series_id) AS pos
          FROM nat JOIN ids ON ids.series_id = nat.series_id)))))"""

CM = f"{SM}, {ASG}, cm AS (SELECT sm.*, asg.cluster_id FROM sm JOIN asg ON sm.dataset = asg.dataset AND sm.series_id = asg.series_id)"
CM_GAPS = f"{SM_GAPS}, {ASG}, cm AS (SELECT sm.*, asg.cluster_id FROM sm JOIN asg ON sm.dataset = asg.dataset AND sm.series_id = asg.series_id)"

UD = f"""ucell AS (SELECT user_id AS series_id, date_diff('day', DATE '{START_DAY}', ts::DATE) AS t, avg(value) AS v
  FROM events GROUP BY 1, 2),
ud AS (SELECT 'events' AS dataset, g.series_id, g.t, v AS value FROM
  (SELECT series_id, t FROM (SELECT DISTINCT series_id FROM ucell) CROSS JOIN (SELECT unnest(range((SELECT min(t) FROM ucell), (SELECT max(t) + 1 FROM ucell))) AS t)) g
  LEFT JOIN ucell c ON c.series_id = g.series_id AND c.t = g.t)"""

ES = """es AS (SELECT 'embeddings' AS dataset, vec_id AS series_id, label::BIGINT AS cluster_id,
  generate_subscripts(embedding, 1) - 1 AS t, unnest(embedding)::DOUBLE AS value FROM embeddings)"""

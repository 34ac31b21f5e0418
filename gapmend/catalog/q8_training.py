"""Training-set operators on the labelled embeddings."""

from pyspark.sql import functions as F

from gapmend.catalog.base import query, rounded, table
from gapmend.functions.columns import r6
from gapmend.operators import training as T
from gapmend.operators.series import known_label_filter
from gapmend.session import scratch_path
from gapmend.sources import stages


def labelled(spark, d):
    """(dataset, series_id, cluster_id, label, category, features) from the embeddings."""
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    return e.select(F.concat(F.lit("d"), (i % 7).cast("string")).alias("dataset"), i.alias("series_id"),
                    F.floor(i / 8).cast("bigint").alias("cluster_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"),
                    F.concat(F.lit("c"), (i % 5).cast("string")).alias("category"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"))


LB = """lb AS (SELECT 'd' || (vec_id % 7) AS dataset, vec_id AS series_id, vec_id // 8 AS cluster_id, 'L' || label AS label, 'c' || (vec_id % 5) AS category,
  embedding::DOUBLE[] AS features FROM embeddings)"""


def uneven(spark, d):
    """The same rows with uneven classes: labels 0-4 merged, 5 and 6 merged, 9 thinned out."""
    lab = F.col("label")
    return labelled(spark, d).where("NOT (label = 'L9' AND series_id % 4 <> 0)").withColumn(
        "label", F.when(lab < "L5", "A").when(lab < "L7", "B").otherwise(lab))


UN = f"""{LB}, un AS (SELECT dataset, series_id, cluster_id, category, features, CASE WHEN label < 'L5' THEN 'A' WHEN label < 'L7' THEN 'B' ELSE label END AS label
  FROM lb WHERE NOT (label = 'L9' AND series_id % 4 <> 0))"""


def sc(col, salt=0):
    return f"((({col}) % 10007) * 7919 + {104729 + 31 * salt}) % 10007"


def rk(part, col="series_id", salt=0):
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {sc(col, salt)}, {col})"


@query("reserve_test_one_cluster", f"""WITH {LB} SELECT dataset, cluster_id FROM (SELECT dataset, min(cluster_id) AS cluster_id, row_number() OVER (ORDER BY dataset) n
  FROM lb GROUP BY 1) WHERE n % 2 = 1""")
def _(spark, d):
    return T.reserve_test_one_cluster(labelled(spark, d))


@query("reserve_test_clusters", f"""WITH {LB}, c AS (SELECT DISTINCT cluster_id FROM lb)
  SELECT 'all' AS dataset, cluster_id FROM (SELECT *, {rk('', 'cluster_id')} rn, count(*) OVER () n FROM c) WHERE rn <= ceil(n * 0.35::DOUBLE)""")
def _(spark, d):
    return T.reserve_test_clusters(labelled(spark, d).withColumn("dataset", F.lit("all")))


@query("reserve_test_series", f"WITH {LB} SELECT dataset, series_id FROM (SELECT *, {rk('')} rn, count(*) OVER () n FROM lb) WHERE rn <= ceil(n * 0.35::DOUBLE)")
def _(spark, d):
    return T.reserve_test_series(labelled(spark, d))


def split_sql(src, share, label="label", col="series_id", salt=0):
    return f"""SELECT *, CASE WHEN nl > 1 AND rn <= round(nl * {share}::DOUBLE) THEN 'test' ELSE 'train' END AS split
      FROM (SELECT *, {rk(label, col, salt)} rn, count(*) OVER (PARTITION BY {label}) nl FROM {src})"""


@query("stratified_split", f"WITH {UN} SELECT series_id, label, split FROM ({split_sql('un', 0.25)})")
def _(spark, d):
    return T.stratified_split(uneven(spark, d).select("series_id", "label"), 0.25)


@query("split_clusters_stratified", f"""WITH {UN}, h AS (SELECT cluster_id, arg_min(label, series_id) AS label FROM un GROUP BY 1), s AS ({split_sql('h', 0.25, col='cluster_id')})
  SELECT un.series_id, un.cluster_id, un.label, split FROM un JOIN s ON s.cluster_id = un.cluster_id""")
def _(spark, d):
    return T.split_clusters_stratified(uneven(spark, d).select("series_id", "cluster_id", "label"))


WS = f"""w AS (SELECT cluster_id, 1.0 + cluster_id % 3 AS weight FROM lb GROUP BY 1), z AS (SELECT cluster_id, count(*) size FROM lb GROUP BY 1),
  k AS (SELECT w.*, size, round(-ln(({sc('w.cluster_id')} + 1) / 10008.0::DOUBLE) / weight, 9) AS key FROM w JOIN z ON w.cluster_id = z.cluster_id),
  sp AS (SELECT cluster_id, weight, CASE WHEN (sum(size) OVER (ORDER BY key, cluster_id ROWS UNBOUNDED PRECEDING) - size) / sum(size) OVER () < 0.6875 THEN 'train' ELSE 'test' END AS split FROM k)"""


def weights(spark, d):
    lb = labelled(spark, d)
    return lb, lb.select("cluster_id").distinct().withColumn("weight", 1.0 + F.col("cluster_id") % 3)


@query("split_weighted_clusters", f"WITH {LB}, {WS} SELECT cluster_id, split FROM sp")
def _(spark, d):
    lb, w = weights(spark, d)
    return T.split_weighted_clusters(lb, w)


@query("update_split_weights", f"""WITH {LB}, {WS} SELECT cluster_id, round(CASE WHEN split = 'train' THEN weight / 2
  ELSE weight + (sum(CASE WHEN split = 'train' THEN weight / 2 ELSE 0 END) OVER ()) / (count(*) FILTER (WHERE split = 'test') OVER ()) END, 6) AS weight FROM sp""")
def _(spark, d):
    lb, w = weights(spark, d)
    return rounded(T.update_split_weights(w, T.split_weighted_clusters(lb, w)), "weight")


@query("cv_splits", f"WITH {UN} " + " UNION ALL ".join(
    f"SELECT series_id, label, {i}::INTEGER AS split_id, split FROM ({split_sql('un', 0.25, salt=i)})" for i in range(3)))
def _(spark, d):
    return T.cv_splits(uneven(spark, d).select("series_id", "label"))


@query("stratified_kfold", f"WITH {UN} SELECT series_id, label, (({rk('label')} - 1) % 5)::INTEGER AS fold FROM un")
def _(spark, d):
    return T.stratified_kfold(uneven(spark, d).select("series_id", "label"), 5)


@query("reduce_stratified", f"WITH {UN} SELECT series_id, label FROM ({split_sql('un', 0.4)}) WHERE split = 'train'")
def _(spark, d):
    return T.reduce_stratified(uneven(spark, d).select("series_id", "label"), 0.6)


@query("balance_all_same", f"""WITH {UN} SELECT series_id, label FROM (SELECT *, {rk('label')} rn FROM un)
  WHERE rn <= (SELECT min(c) FROM (SELECT count(*) c FROM un GROUP BY label))""")
def _(spark, d):
    return T.balance_all_same(uneven(spark, d).select("series_id", "label"))


@query("balance_rmv_min_reduce_max", f"""WITH {UN}, n AS (SELECT label, count(*) n, count(*) / sum(count(*)) OVER () s FROM un GROUP BY 1),
  k AS (SELECT label, CASE WHEN s > 0.2 THEN (SELECT max(n) FROM n WHERE s BETWEEN 0.05 AND 0.2) ELSE n END AS take FROM n WHERE s >= 0.05)
  SELECT series_id, r.label FROM (SELECT *, {rk('label')} rn FROM un) r JOIN k ON k.label = r.label WHERE rn <= take""")
def _(spark, d):
    return T.balance_rmv_min_reduce_max(uneven(spark, d).select("series_id", "label"))


@query("incremental_subset", f"""WITH {UN} SELECT series_id, label, i::INTEGER AS iteration FROM (SELECT *, {rk('label')} rn, count(*) OVER (PARTITION BY label) nl FROM un)
  CROSS JOIN (SELECT unnest([2, 7, 12, 20, 50]) s, unnest([0, 1, 2, 3, 4]) i) WHERE rn <= ceil(nl * s / 100)""")
def _(spark, d):
    return T.incremental_subset(uneven(spark, d).select("series_id", "label"))


@query("all_data", f"WITH {LB} SELECT dataset, series_id, cluster_id, label FROM lb")
def _(spark, d):
    return T.all_data(labelled(spark, d).select("dataset", "series_id", "cluster_id", "label"))


SMOTE = f"""n AS (SELECT label, count(*) n FROM un GROUP BY 1), m AS (SELECT max(n) mx, least(min(n) - 1, 5) k FROM n),
  ds AS (SELECT a.series_id, b.series_id nid, row_number() OVER (PARTITION BY a.series_id ORDER BY round(list_distance(a.features, b.features), 9), b.series_id) r
    FROM un a JOIN un b ON a.label = b.label AND a.series_id <> b.series_id),
  bs AS (SELECT un.*, n.n, mx - n.n extra, k, {rk('un.label', 'un.series_id')} rn FROM un JOIN n ON n.label = un.label CROSS JOIN m WHERE n.n < mx),
  rw AS (SELECT *, rn - 1 + q * n AS i FROM bs CROSS JOIN (SELECT unnest(range(1000)) q) WHERE rn - 1 + q * n < extra),
  nw AS (SELECT rw.series_id, rw.label, i, rw.features v, w.features w, ((((i * 13 + rw.series_id) % 10007) * 7919 + 104729) % 10007) / 10007.0::DOUBLE u
    FROM rw JOIN ds ON ds.series_id = rw.series_id AND ds.r = (i * 7 + rw.series_id) % k + 1 JOIN un w ON w.series_id = ds.nid)
  SELECT series_id, label, false AS synthetic, list_transform(features, lambda x: round(x, 6) + 0.0) AS features FROM un
  UNION ALL SELECT -(series_id * 1000003 + i + 1), label, true, list_transform(list_zip(v, w), lambda z: round(z[1] + u * (z[2] - z[1]), 6) + 0.0) FROM nw"""


@query("smote", f"WITH {UN}, {SMOTE}")
def _(spark, d):
    return T.smote(uneven(spark, d)).withColumn("features", F.transform("features", lambda x: r6(x)))


@query("info_set")
def _(spark, d):
    s = T.stratified_split(uneven(spark, d), 0.25)
    return stages.info_set(s.where("split = 'train'"), s.where("split = 'test'"), ["knn"], [f"e{i}" for i in range(64)])

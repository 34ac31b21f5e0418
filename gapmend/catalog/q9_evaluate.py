"""Evaluation and race statistics."""

from pyspark.sql import functions as F

from gapmend.catalog.base import query, rounded, table
from gapmend.catalog.q4_stats import student_sql
from gapmend.catalog.q8_training import LB, labelled
from gapmend.operators import evaluate as E, race as R

PARTS = {"low": (0, 32), "high": (32, 64), "all": (0, 64)}


def centroid_predictions(spark, d, part="all"):
    """Class probabilities from the distance to the mean vector of each label."""
    lo, hi = PARTS[part]
    lb = labelled(spark, d).select("series_id", "category", F.col("label").alias("true_label"), F.slice("features", lo + 1, hi - lo).alias("x"))
    cell = lb.select("true_label", F.posexplode("x").alias("i", "v")).groupBy("true_label", "i").agg(F.avg("v").alias("m"))
    cen = cell.groupBy(F.col("true_label").alias("class")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("c"))
    # one array holds all classes, so rows meet it once
    table_ = cen.agg(F.array_sort(F.collect_list(F.struct("class", "c"))).alias("cs"))
    w = lambda e: F.exp(-F.aggregate(F.zip_with("x", e["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    s = lb.join(table_).select("series_id", "category", "true_label", F.transform("cs", lambda e: F.struct(e["class"].alias("class"), w(e).alias("w"))).alias("ws"))
    total = F.aggregate("ws", F.lit(0.0), lambda a, e: a + e["w"])
    return s.select("series_id", "category", "true_label", total.alias("z"), F.explode("ws").alias("e")).select(
        "series_id", "category", "true_label", F.col("e.class").alias("class"), F.round(F.col("e.w") / F.col("z"), 9).alias("probability"))


def pred_sql(name, part):
    lo, hi = PARTS[part]
    return f"""{name}c AS (SELECT label AS class, i, avg(features[i]) m FROM lb CROSS JOIN (SELECT unnest(range({lo + 1}, {hi + 1})) i) GROUP BY 1, 2),
  {name}w AS (SELECT series_id, category, label AS true_label, class, exp(-sum(pow(features[i] - m, 2))) w FROM lb JOIN {name}c ON true GROUP BY 1, 2, 3, 4),
  {name} AS (SELECT series_id, category, true_label, class, round(w / sum(w) OVER (PARTITION BY series_id), 9) AS probability FROM {name}w)"""


PR = f"{LB}, {pred_sql('pr', 'all')}"
PL = f"""pl AS (SELECT series_id, category, true_label, class AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY probability DESC, class) n FROM pr) WHERE n = 1)"""
TR = """rx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY probability DESC, class DESC)::INTEGER AS rank FROM pr),
  tr AS (SELECT series_id, category, true_label, min(rank) FILTER (WHERE class = true_label) AS rank FROM rx GROUP BY 1, 2, 3)"""


@query("centroid_predictions", f"WITH {PR} SELECT series_id, category, true_label, class, round(probability, 6) AS probability FROM pr")
def _(spark, d):
    return rounded(centroid_predictions(spark, d), "probability")


@query("soft_vote", f"""WITH {PR}, {pred_sql('pa', 'low')}, {pred_sql('pb', 'high')} SELECT series_id, category, true_label, class, round(avg(probability), 6) AS probability
  FROM (SELECT * FROM pr UNION ALL SELECT * FROM pa UNION ALL SELECT * FROM pb) GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return rounded(E.soft_vote([centroid_predictions(spark, d, p) for p in PARTS]), "probability")


@query("decision_to_proba", f"""WITH {LB} SELECT series_id, i AS class_index, round((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0), 6) AS probability
  FROM (SELECT series_id, i::INTEGER - 1 AS i, features[i] AS x FROM lb CROSS JOIN (SELECT unnest(range(1, 65)) i))""")
def _(spark, d):
    v = labelled(spark, d).select("series_id", F.posexplode("features").alias("class_index", "decision"))
    return rounded(E.decision_to_proba(v), "probability").drop("decision")


@query("predict_label", f"WITH {PR}, {PL} SELECT * FROM pl")
def _(spark, d):
    return E.predict_label(centroid_predictions(spark, d))


@query("rank_recommendations", f"WITH {PR}, {TR} SELECT series_id, category, true_label, class, round(probability, 6) AS probability, rank FROM rx")
def _(spark, d):
    return rounded(E.rank_recommendations(centroid_predictions(spark, d)), "probability")


# labels L8 and L9 are unknown to this recommender
@query("true_label_rank", f"""WITH {PR}, kn AS (SELECT * FROM pr WHERE class < 'L8'), rx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY probability DESC, class DESC)::INTEGER AS rank FROM kn)
  SELECT series_id, category, true_label, min(rank) FILTER (WHERE class = true_label) AS rank FROM rx GROUP BY 1, 2, 3""")
def _(spark, d):
    return E.true_rank(centroid_predictions(spark, d).where(F.col("class") < "L8"))


def cls_sql(src):
    """Weighted metrics of (category, true_label, predicted) rows, per category"""
    return f"""(SELECT category, sum(sup)::BIGINT AS n, sum(tp) / sum(sup) AS accuracy, sum(sup * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(sup) AS f1,
    sum(sup * p) / sum(sup) AS precision, sum(sup * r) / sum(sup) AS recall FROM (
     SELECT *, coalesce(tp / nullif(pre, 0), 0) p, coalesce(tp / nullif(sup, 0), 0) r FROM (
      SELECT category, c, count(*) FILTER (WHERE true_label = c) sup, count(*) FILTER (WHERE predicted = c) pre, count(*) FILTER (WHERE true_label = c AND predicted = c) tp
      FROM {src} CROSS JOIN (SELECT DISTINCT true_label AS c FROM {src} UNION SELECT DISTINCT predicted FROM {src}) GROUP BY 1, 2)) GROUP BY 1)"""


RND = "round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall"
MET = ["accuracy", "f1", "precision", "recall"]
RKM = "round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(coalesce(rank <= 3, false)::INT) / 3, 6) AS precision_at_3, round(avg(coalesce(rank <= 3, false)::INT), 6) AS recall_at_3"
RKC = ["mrr", "precision_at_3", "recall_at_3"]


@query("eval_classification", f"WITH {PR}, {PL}, al AS (SELECT 'x' AS category, true_label, predicted FROM pl) SELECT n, {RND} FROM {cls_sql('al')}")
def _(spark, d):
    return rounded(E.eval_classification(E.predict_label(centroid_predictions(spark, d))), *MET)


@query("eval_ranking", f"WITH {PR}, {TR} SELECT {RKM} FROM tr")
def _(spark, d):
    return rounded(E.eval_ranking(E.true_rank(centroid_predictions(spark, d))), *RKC)


@query("eval_by_category", f"""WITH {PR}, {PL}, {TR}, al AS (SELECT category, true_label, predicted FROM pl UNION ALL SELECT '(all)', true_label, predicted FROM pl),
  ra AS (SELECT category, rank FROM tr UNION ALL SELECT '(all)', rank FROM tr), rm AS (SELECT category, {RKM} FROM ra GROUP BY 1)
  SELECT m.category, n, {RND}, mrr, precision_at_3, recall_at_3 FROM {cls_sql('al')} m JOIN rm ON rm.category = m.category""")
def _(spark, d):
    return rounded(E.eval_by_category(centroid_predictions(spark, d)), *MET, *RKC)


def vectors(spark, d):
    """0/1 vectors: the true label and one more class; all classes above even odds."""
    p = centroid_predictions(spark, d)
    truth = (F.col("class") == F.col("true_label")) | (F.col("class") == F.concat(F.lit("L"), (F.col("series_id") % 10).cast("string")))
    rows = F.array_sort(F.collect_list(F.struct("class", truth.cast("double").alias("t"), (F.col("probability") >= 0.1).cast("double").alias("g"))))
    return p.groupBy("series_id").agg(rows.alias("r")).select(
        "series_id", F.transform("r", lambda x: x["t"]).alias("truth"), F.transform("r", lambda x: x["g"]).alias("guess"))


ML = f"{PR}, ml AS (SELECT series_id, class, (class = true_label OR class = 'L' || (series_id % 10))::INT t, (probability >= 0.1)::INT g FROM pr)"


@query("eval_multilabel", f"""WITH {ML}, s AS (SELECT series_id, sum(t * g) tp, sum(t) t, sum(g) g, bool_and(t = g) same FROM ml GROUP BY 1)
  SELECT round(avg(coalesce(tp / nullif(g, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(t, 0), 0)), 6) AS recall,
   round(avg(coalesce(2 * tp / nullif(t + g, 0), 0)), 6) AS f1, round(avg(same::INT), 6) AS accuracy FROM s""")
def _(spark, d):
    return rounded(E.eval_multilabel(vectors(spark, d)), *MET)


@query("confusion_multilabel", f"""WITH {ML} SELECT class, count(*) FILTER (WHERE t = 0 AND g = 0) AS tn, count(*) FILTER (WHERE t = 0 AND g = 1) AS fp,
  count(*) FILTER (WHERE t = 1 AND g = 0) AS fn, count(*) FILTER (WHERE t = 1 AND g = 1) AS tp FROM ml GROUP BY 1""")
def _(spark, d):
    return E.confusion_multilabel(vectors(spark, d), [f"L{i}" for i in range(10)])


@query("hamming_loss", f"WITH {PR}, {PL} SELECT round(avg((true_label <> predicted)::INT), 6) AS hamming_loss FROM pl")
def _(spark, d):
    return rounded(E.hamming_loss(E.predict_label(centroid_predictions(spark, d))), "hamming_loss")


@query("confusion_matrix", f"WITH {PR}, {PL} SELECT true_label, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pl GROUP BY 1, 2")
def _(spark, d):
    return rounded(E.confusion_matrix(E.predict_label(centroid_predictions(spark, d))), "share")


# --- race statistics ---------------------------------------------------------------

def folds(spark, d, n=30):
    """Fold scores per (pipeline, fold): events of a user group on one day."""
    ev = table(spark, d, "events")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    g = ev.groupBy((F.col("user_id") % n).alias("pipeline_id"), day.cast("bigint").alias("fold")).agg(
        F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("runtime"))
    f1 = F.round(F.least(F.lit(1.0), F.col("v") / 40), 9)
    return g.select("pipeline_id", "fold", f1.alias("f1"), F.least(F.lit(1.0), f1 * 1.25).alias("r3"), "runtime")


def fs(n=30):
    return f"""fs AS (SELECT pipeline_id, fold, f1, least(1.0, f1 * 1.25) AS r3, runtime FROM (SELECT user_id % {n} AS pipeline_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS fold,
    round(least(1.0, avg(value) / 40), 9) AS f1, count(*)::DOUBLE AS runtime FROM events GROUP BY 1, 2))"""


SS = "ss AS (SELECT *, (0.5 * f1 + 0.5 * r3 - 0.5 * runtime / (SELECT max(runtime) FROM fs) + 0.5) / 1.5 AS score FROM fs)"
TT = f"""tg AS (SELECT a.pipeline_id AS a, b.pipeline_id AS b, count(*) AS n, avg(a.score - b.score) AS diff, stddev_samp(a.score - b.score) sd, avg(a.score) AS mean_a, avg(b.score) AS mean_b
    FROM ss a JOIN ss b ON a.fold = b.fold AND a.pipeline_id < b.pipeline_id GROUP BY 1, 2),
  tt AS (SELECT a, b, n, diff, mean_a, mean_b, t, CASE WHEN t IS NOT NULL AND n > 1 THEN {student_sql('abs(t)', '(n - 1)')} END AS p FROM (SELECT *, diff / nullif(sd / sqrt(n), 0) AS t FROM tg))"""


@query("selection_score", f"WITH {fs()}, {SS} SELECT pipeline_id, fold, round(f1, 6) AS f1, round(r3, 6) AS r3, runtime, round(score, 6) AS score FROM ss")
def _(spark, d):
    return rounded(R.selection_score(folds(spark, d)), "f1", "r3", "score")


@query("fold_budget", f"WITH {fs(150)} SELECT pipeline_id, count(*) AS n_scores, max(count(*)) OVER () + 3 - count(*) AS budget FROM fs GROUP BY 1")
def _(spark, d):
    return R.fold_budget(folds(spark, d, 150), False)


@query("early_elimination", f"""WITH {fs(150)}, m AS (SELECT pipeline_id, round(avg(f1), 12) f FROM fs GROUP BY 1 HAVING count(*) >= 5)
  SELECT pipeline_id, round(f, 6) AS mean_f1 FROM m WHERE f < (SELECT max(f) FROM m) - 0.15""")
def _(spark, d):
    return rounded(R.early_elimination(folds(spark, d, 150)), "mean_f1")


@query("paired_ttest", f"WITH {fs()}, {SS}, {TT} SELECT a, b, n, round(diff, 6) + 0.0 AS diff, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(t, 6) + 0.0 AS t, round(p, 6) AS p FROM tt")
def _(spark, d):
    return rounded(R.paired_ttest(R.selection_score(folds(spark, d))), "diff", "mean_a", "mean_b", "t", "p")


@query("ztest_pair", f"""WITH {fs()}, {SS}, s AS (SELECT pipeline_id, count(*) n, avg(score) m, var_samp(score) v FROM ss GROUP BY 1),
  z AS (SELECT a.pipeline_id AS a, b.pipeline_id AS b, a.m AS mean_a, b.m AS mean_b, (a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) AS z FROM s a JOIN s b ON a.pipeline_id < b.pipeline_id),
  x AS (SELECT *, abs(z) / sqrt(2) x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) k FROM z)
  SELECT a, b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(z, 6) + 0.0 AS z,
    round(least(1.0, k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-x * x)), 6) AS p FROM x""")
def _(spark, d):
    return rounded(R.ztest_pair(R.selection_score(folds(spark, d))), "mean_a", "mean_b", "z", "p")


LOSS = "ls AS (SELECT CASE WHEN mean_a < mean_b THEN a ELSE b END AS pipeline_id FROM tt WHERE p < 0.2)"


# a loose p-value: the daily scores of the user groups differ little
@query("prune_worse", f"WITH {fs()}, {SS}, {TT}, {LOSS} SELECT pipeline_id, count(*) AS losses FROM ls GROUP BY 1 HAVING count(*) > 3")
def _(spark, d):
    return R.prune_worse(R.paired_ttest(R.selection_score(folds(spark, d))), 30, 8.0, 0.2)


@query("prune_worse_strict", f"WITH {fs()}, {SS}, {TT}, {LOSS} SELECT pipeline_id, count(*) AS losses FROM ls GROUP BY 1")
def _(spark, d):
    return R.prune_worse(R.paired_ttest(R.selection_score(folds(spark, d))), 30, 8.0, 0.2, gentle=False)


@query("prune_final", f"""WITH {fs()}, {SS}, {TT}, {LOSS}, mn AS (SELECT pipeline_id, avg(m) m FROM (SELECT a AS pipeline_id, mean_a AS m FROM tt UNION ALL SELECT b, mean_b FROM tt) GROUP BY 1),
  rn AS (SELECT *, row_number() OVER (ORDER BY round(m, 9), pipeline_id) r FROM mn WHERE pipeline_id IN (SELECT pipeline_id FROM ls))
  SELECT pipeline_id, round(m, 6) AS mean_score FROM rn WHERE r <= (SELECT count(*) FROM mn) - 20""")
def _(spark, d):
    return rounded(R.prune_final(R.paired_ttest(R.selection_score(folds(spark, d))), 20, 0.2), "mean_score")


@query("prune_schedule", """WITH s AS (SELECT event_type, count(DISTINCT user_id) AS n0 FROM events GROUP BY 1)
  SELECT event_type, n0, i::INTEGER AS iteration, floor(round(n0 / pow(pow(n0 / 5, 1.0::DOUBLE / 5), i), 9))::BIGINT AS max_pipelines FROM s CROSS JOIN (SELECT unnest(range(5)) i)""")
def _(spark, d):
    return R.prune_schedule(table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n0")))


@query("score_parameter_sweep", f"""WITH {fs()}, m AS (SELECT pipeline_id, avg(f1) f1, avg(r3) r3, avg(runtime / (SELECT max(runtime) FROM fs)) rt FROM fs GROUP BY 1),
  w AS (SELECT p AS parameter, v AS value, CASE WHEN p = 'alpha' THEN v ELSE 0.5 END a, CASE WHEN p = 'beta' THEN v ELSE 0.5 END b, CASE WHEN p = 'gamma' THEN v ELSE 0.5 END c
    FROM (SELECT unnest(['alpha', 'beta', 'gamma']) p) CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) v)),
  s AS (SELECT pipeline_id, parameter, value, (a * f1 + b * r3 - c * rt + c) / (a + b + c) AS score FROM m CROSS JOIN w)
  SELECT pipeline_id, parameter, value, round(score, 6) AS score, row_number() OVER (PARTITION BY parameter, value ORDER BY round(score, 9) DESC, pipeline_id)::INTEGER AS rank FROM s""")
def _(spark, d):
    return rounded(R.score_parameter_sweep(folds(spark, d)), "score")


@query("results_summary", f"""WITH {fs()} SELECT pipeline_id AS model, count(*) AS n_splits, round(avg(f1), 6) AS mean_f1, round(min(f1), 6) AS min_f1, round(max(f1), 6) AS max_f1,
  round(avg(r3), 6) AS mean_r3, round(avg(runtime), 6) AS mean_runtime, arg_min(fold, {{'o': -round(f1, 9), 'f': fold}}) AS best_split FROM fs GROUP BY 1""")
def _(spark, d):
    f = folds(spark, d).withColumnsRenamed({"pipeline_id": "model", "fold": "split_id"})
    return rounded(E.results_summary(f), "mean_f1", "min_f1", "max_f1", "mean_r3", "mean_runtime")

"""Transforms, classifiers, candidate grid, race and recommendation."""

from pyspark.sql import functions as F

from gapmend.catalog.base import ORACLE, embedding_series, query, rounded
from gapmend.catalog.q8_training import LB, labelled, split_sql
from gapmend.functions.columns import r6
from gapmend.operators import evaluate as E, models as M, training as T
from gapmend.operators.features import stats as X
from gapmend.plans import racing
from gapmend.session import scratch_path
from gapmend.sources import stages


def parts(spark, d):
    s = T.stratified_split(labelled(spark, d), 0.35)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


SP = f"""{LB}, sp AS ({split_sql('lb', 0.35)}), tn AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test')"""
ROUND_L = "list_transform({0}, lambda x: round(x, 6) + 0.0)"


def show(df):
    return df.select("series_id", F.transform("features", lambda x: r6(x)).alias("features"))


def predictions(df):
    return rounded(df, "probability").select("series_id", "true_label", "class", "probability")


for norm, size in (("l1", "list_sum(list_transform(features, lambda x: abs(x)))"), ("l2", "sqrt(list_sum(list_transform(features, lambda x: x * x)))")):
    @query(f"t_normalizer_{norm}", f"WITH {LB} SELECT series_id, list_transform(features, lambda x: round(x / {size}, 6) + 0.0) AS features FROM lb")
    def _(spark, d, norm=norm):
        return show(M.normalize_rows(labelled(spark, d), norm))

COLS = "cl AS (SELECT i, max(abs(v)) mx, avg(v) mu, stddev_pop(v) sd FROM (SELECT unnest(features) v, unnest(range(64)) i FROM tn) GROUP BY 1), lx AS (SELECT list(mx ORDER BY i) mx, list(mu ORDER BY i) mu, list(sd ORDER BY i) sd FROM cl)"


@query("t_maxabs", f"WITH {SP}, {COLS} SELECT series_id, list_transform(features, lambda x, i: round(x / mx[i], 6) + 0.0) AS features FROM te CROSS JOIN lx")
def _(spark, d):
    tr, te = parts(spark, d)
    return show(M.fit_maxabs(tr).apply(te))


@query("t_standard", f"WITH {SP}, {COLS} SELECT series_id, list_transform(features, lambda x, i: round((x - mu[i]) / sd[i], 6) + 0.0) AS features FROM te CROSS JOIN lx")
def _(spark, d):
    tr, te = parts(spark, d)
    return show(M.fit_standard(tr).apply(te))


@query("t_quantile")
def _(spark, d):
    tr, te = parts(spark, d)
    return show(M.fit_quantile(tr).apply(te))


@query("t_pca")
def _(spark, d):
    tr, te = parts(spark, d)
    return show(M.fit_pca(tr).apply(te))


NN = """dd AS (SELECT te.series_id, te.label AS true_label, tn.label, tn.series_id AS nid, round(list_distance(te.features, tn.features), 9) AS dist FROM te JOIN tn ON true),
  nr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dist, nid) r FROM dd)"""


def vote_sql(src, weight):
    return f"""vt AS (SELECT series_id, label, sum(w) w FROM (SELECT *, {weight} w FROM {src}) GROUP BY 1, 2), tt AS (SELECT series_id, sum(w) s FROM vt GROUP BY 1)
  SELECT te.series_id, te.label AS true_label, c.label AS class, round(coalesce(w, 0) / s, 6) AS probability FROM te CROSS JOIN (SELECT DISTINCT label FROM tn) c
  JOIN tt ON tt.series_id = te.series_id LEFT JOIN vt ON vt.series_id = te.series_id AND vt.label = c.label"""


for kind, weight in (("uniform", "1.0"), ("distance", "CASE WHEN min(dist) OVER (PARTITION BY series_id) = 0 THEN (dist = 0)::INT ELSE 1 / dist END")):
    @query(f"clf_knn_{kind}", f"WITH {SP}, {NN}, nk AS (SELECT * FROM nr WHERE r <= 5), {vote_sql('nk', weight)}")
    def _(spark, d, kind=kind):
        tr, te = parts(spark, d)
        return predictions(M.fit(tr, M.Spec("knn", {"n_neighbors": 5, "weights": kind})).predict(te))

    @query(f"clf_radius_{kind}", f"""WITH {SP}, {NN}, nk AS (SELECT series_id, label, dist FROM nr WHERE dist <= 1.15 UNION ALL SELECT series_id,
      (SELECT label FROM tn GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), 1.0 FROM te WHERE series_id NOT IN (SELECT series_id FROM nr WHERE dist <= 1.15)), {vote_sql('nk', weight)}""")
    def _(spark, d, kind=kind):
        tr, te = parts(spark, d)
        return predictions(M.fit(tr, M.Spec("radius", {"radius": 1.15, "weights": kind})).predict(te))


@query("clf_gaussian_nb", f"""WITH {SP}, tx AS (SELECT label, i, v FROM (SELECT label, unnest(features) v, unnest(range(64)) i FROM tn)),
  ep AS (SELECT max(v) * 1e-9 e FROM (SELECT var_samp(v) v FROM tx GROUP BY i)),
  gs AS (SELECT label, i, avg(v) mu, var_pop(v) + (SELECT e FROM ep) va FROM tx GROUP BY 1, 2), pi AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tn)) p FROM tn GROUP BY 1),
  ex AS (SELECT series_id, label AS true_label, unnest(features) v, unnest(range(64)) i FROM te),
  ll AS (SELECT series_id, true_label, gs.label, sum(-0.5 * (ln(2 * pi() * va) + (v - mu) * (v - mu) / va)) + max(p) s FROM ex JOIN gs ON ex.i = gs.i JOIN pi ON pi.label = gs.label GROUP BY 1, 2, 3),
  nm AS (SELECT *, exp(s - max(s) OVER (PARTITION BY series_id)) w FROM ll)
  SELECT series_id, true_label, label AS class, round(w / sum(w) OVER (PARTITION BY series_id), 6) AS probability FROM nm""")
def _(spark, d):
    tr, te = parts(spark, d)
    return predictions(M.fit(tr, M.Spec("gaussian_nb")).predict(te))


@query("clf_bernoulli_nb", f"""WITH {SP}, tx AS (SELECT label, i, (v > 0)::INT v FROM (SELECT label, unnest(features) v, unnest(range(64)) i FROM tn)),
  th AS (SELECT label, i, ln((sum(v) + 1) / (count(*) + 2)) l1, ln(1 - (sum(v) + 1) / (count(*) + 2)) l0 FROM tx GROUP BY 1, 2),
  pi AS (SELECT label, ln((count(*) + 1) / ((SELECT count(*) FROM tn) + (SELECT count(DISTINCT label) FROM tn))) p FROM tn GROUP BY 1),
  ex AS (SELECT series_id, label AS true_label, unnest(features) v, unnest(range(64)) i FROM te),
  ll AS (SELECT series_id, true_label, th.label, sum(CASE WHEN v > 0 THEN l1 ELSE l0 END) + max(p) s FROM ex JOIN th ON ex.i = th.i JOIN pi ON pi.label = th.label GROUP BY 1, 2, 3),
  nm AS (SELECT *, exp(s - max(s) OVER (PARTITION BY series_id)) w FROM ll)
  SELECT series_id, true_label, label AS class, round(w / sum(w) OVER (PARTITION BY series_id), 6) AS probability FROM nm""")
def _(spark, d):
    tr, te = parts(spark, d)
    return predictions(M.fit(tr, M.Spec("bernoulli_nb", {"alpha": 1.0})).predict(te))


for clf, params in (("gbt", {"iterations": 10, "depth": 4}), ("rf", {"n_estimators": 50, "max_depth": 8}), ("dt", {"max_depth": 8}),
                    ("extra_tree", {"max_depth": 8}), ("lda", {}), ("qda", {}), ("logreg", {"C": 1}), ("mlp", {"hidden": 50})):
    @query(f"clf_{clf}")
    def _(spark, d, clf=clf, params=params):
        tr, te = parts(spark, d)
        return predictions(M.fit(tr, M.Spec(clf, params)).predict(te))


_vals = ", ".join(f"('{c}', '{p}')" for c in sorted(M.GRID) for p in M._param_texts(c))
GR = f"""{SP}, gr AS (SELECT *, row_number() OVER (ORDER BY classifier, params, normalizer, scaler, reduction) - 1 AS pipeline_id FROM
  (SELECT unnest({M.NORMALIZERS}) AS normalizer) CROSS JOIN (SELECT unnest({M.SCALERS}) AS scaler) CROSS JOIN (SELECT unnest({M.REDUCTIONS}) AS reduction)
  CROSS JOIN (VALUES {_vals}) v(classifier, params)
  WHERE coalesce(try_cast(regexp_extract(params, 'n_neighbors=([0-9]+)', 1) AS INT), 0) <= (SELECT count(*) FROM tn)),
  sm AS (SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY ((pipeline_id % 10007) * 7919 + 104729) % 10007, pipeline_id) turn FROM gr),
  s60 AS (SELECT * EXCLUDE turn FROM (SELECT * FROM sm ORDER BY turn, classifier LIMIT 60))"""


@query("candidate_grid", f"WITH {GR} SELECT * FROM gr")
def _(spark, d):
    return M.candidate_grid(parts(spark, d)[0])


@query("candidate_sample", f"WITH {GR} SELECT * FROM s60")
def _(spark, d):
    return M.sample_candidates(M.candidate_grid(parts(spark, d)[0]), 60)


@query("candidate_mutate", f"""WITH {GR}, sv AS (SELECT * FROM s60 WHERE pipeline_id IN (SELECT pipeline_id FROM s60 ORDER BY pipeline_id LIMIT 6)), fr AS (SELECT * FROM gr WHERE pipeline_id NOT IN (SELECT pipeline_id FROM s60)),
  kn AS (SELECT fr.pipeline_id, min(sv.pipeline_id) AS parent FROM sv JOIN fr USING (normalizer, scaler, reduction, classifier) GROUP BY 1),
  k1 AS (SELECT pipeline_id FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ((pipeline_id % 10007) * 7919 + 104729) % 10007, pipeline_id) rn FROM kn) WHERE rn <= 3),
  rs AS (SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY ((pipeline_id % 10007) * 7919 + 104729) % 10007, pipeline_id) turn FROM fr WHERE pipeline_id NOT IN (SELECT pipeline_id FROM k1))
  SELECT pipeline_id, 'kin' AS origin FROM k1 UNION ALL SELECT pipeline_id, 'random' FROM (SELECT * FROM rs ORDER BY turn, classifier LIMIT 10)""")
def _(spark, d):
    grid = M.candidate_grid(parts(spark, d)[0])
    used = M.sample_candidates(grid, 60)
    return M.mutate_candidates(grid, used.orderBy("pipeline_id").limit(6), used, 30, 6)


#: Candidates that start in a race and about how many remain, as in the studied work.
RACE_START, RACE_TARGET = 250, 5


def race(spark, d):
    """Winners and scores of a race of the whole grid, and the rows it ran on."""
    tr, te = parts(spark, d)
    tr, te = tr.persist(), te.persist()
    return *racing.model_race(tr, te, M.candidate_grid(tr), RACE_START, RACE_TARGET), tr, te


@query("model_race")
def _(spark, d):
    _, scores, _, _ = race(spark, d)
    return rounded(scores, "f1", "r3").select("pipeline_id", "fold", "f1", "r3")


@query("train_cv")
def _(spark, d):
    winners, _, _, _ = race(spark, d)
    scores, _ = racing.train_cv(labelled(spark, d), winners)
    return rounded(scores, "f1", "r3").drop("runtime")


@query("recommend")
def _(spark, d):
    winners, _, tr, te = race(spark, d)
    labels = [f"L{i}" for i in range(10)]
    return rounded(racing.recommend([M.fit(tr, s) for s in winners], te, labels), *labels)


#: Models of each way of storing one; a loaded model must predict what its own query expects.
for name, spec, like in (("save_run", M.Spec("gaussian_nb"), "clf_gaussian_nb"), ("load_run", M.Spec("knn", {"n_neighbors": 5, "weights": "distance"}), "clf_knn_distance")):
    @query(name, ORACLE[like])
    def _(spark, d, spec=spec):
        tr, te = parts(spark, d)
        root = scratch_path(spark, "run")
        keep = ["dataset", "series_id", "category", "label", "features"]
        stages.save_run(root, {spec.classifier: M.fit(tr, spec)}, tr.select(keep), te.select(keep), {"features": 64, "test_share": 0.35})
        models, _, test, _ = stages.load_run(spark, root)
        return predictions(models[spec.classifier].predict(test))


@query("hyperparam_search")
def _(spark, d):
    return rounded(racing.hyperparam_search(labelled(spark, d)), "f1")


@query("feature_set_sweep")
def _(spark, d):
    """Metrics of one classifier on the seven combinations of three feature families."""
    s = embedding_series(spark, d)
    lab = s.select("series_id", F.concat(F.lit("L"), F.col("cluster_id").cast("string")).alias("label")).distinct()
    s = s.drop("cluster_id")
    fams = {"basic": X.basic(s), "changes": X.changes(s), "trend": X.linear_trend(s)}
    names = {}
    long = None
    for k, f in fams.items():
        f = f.withColumn("family", F.lit(k))
        long = f if long is None else long.unionByName(f)
    wide = long.groupBy("series_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(
        F.col("family") == k, F.struct("feature", F.coalesce("value", F.lit(0.0)).alias("value"))))), lambda v: v["value"]).alias(k) for k in fams])
    # the split looks at ids and labels only, so one serves all combinations
    wide = T.stratified_split(wide.join(lab, "series_id"), 0.35).persist()
    rows = []
    for mask in range(1, 8):
        use = [k for i, k in enumerate(fams) if mask >> i & 1]
        data = wide.select("series_id", "label", F.concat(*use).alias("features"), "split")
        model = M.fit(data.where("split = 'train'").drop("split"), M.Spec("lda", scaler="standard"))
        m = E.eval_classification(E.predict_label(model.predict(data.where("split = 'test'").drop("split")))).first()
        rows.append(("+".join(use), m["n"], round(m["accuracy"], 6), round(m["f1"], 6)))
    return spark.createDataFrame(rows, "families string, n bigint, accuracy double, f1 double")

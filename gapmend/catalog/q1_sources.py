"""Sources, sinks and scans."""

from pyspark.sql import functions as F

from gapmend.catalog.base import (CM, ES, SM, SM_GAPS, UD, clustered_month, embedding_series, query, rounded,
                                  supplier_month, table, user_day)
from gapmend.operators import series as S
from gapmend.session import scratch_path
from gapmend.sources import files, stages, tables



def type_hour(spark, d):
    """Events per type and hour: five long series."""
    ev = table(spark, d, "events")
    names = ev.select("event_type").distinct()
    ids = S.ranked(names, [], ["event_type"], F.ascii("event_type"), "id").select(
        "event_type", (F.col("id") - 1).alias("id"))
    hour = (tables.day_step("ts", "2024-01-01") * 24 + F.hour("ts")).cast("bigint")
    return tables.series_from_table(ev.join(ids, "event_type"), "id", hour, F.count(F.lit(1)), 0.0)


TH = f"""ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS series_id FROM (SELECT DISTINCT event_type FROM events)),
hc AS (SELECT series_id, date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts) AS t, count(*) AS v
  FROM events JOIN ty USING (event_type) GROUP BY 1, 2),
th AS (SELECT ty.series_id, g.t, coalesce(v, 0)::DOUBLE AS value FROM ty CROSS JOIN (SELECT unnest(range((SELECT min(t) FROM hc), (SELECT max(t) + 1 FROM hc))) AS t) g
  LEFT JOIN hc ON hc.series_id = ty.series_id AND hc.t = g.t)"""


@query("series_from_table", f"WITH {SM_GAPS} SELECT dataset, series_id, t, value FROM sm")
def _(spark, d):
    return supplier_month(spark, d, fill=None)


@query("series_from_events", f"WITH {UD} SELECT dataset, series_id, t, round(value, 6) + 0.0 AS value FROM ud")
def _(spark, d):
    return rounded(user_day(spark, d), "value")


@query("read_series_wide", f"WITH {TH} SELECT 'hours' AS dataset, series_id, t, value FROM th")
def _(spark, d):
    path = scratch_path(spark, "wide")
    wide = type_hour(spark, d).groupBy("t").agg(F.concat_ws(" ", F.transform(
        F.array_sort(F.collect_list(F.struct("series_id", "value"))), lambda x: x["value"].cast("string"))).alias("value"))
    # one line per time step: the file is as long as the time grid, not the data
    wide.coalesce(1).sortWithinPartitions("t").select("value").write.text(path)
    return files.read_series_wide(spark, path, "hours").select("dataset", "series_id", "t", "value")


@query("read_series_rows", f"""WITH {SM} SELECT 'input' AS dataset,
  dense_rank() OVER (ORDER BY series_id) - 1 AS series_id, t, value FROM sm""")
def _(spark, d):
    path = scratch_path(spark, "rows")
    arr = S.series_to_array(supplier_month(spark, d))
    arr.orderBy("series_id").select(F.concat_ws(" ", F.transform("vals", lambda x: x.cast("string"))).alias("value")).write.text(path)
    return files.read_series_rows(spark, path)


@query("resolve_time_index", f"""WITH {UD} SELECT dataset, series_id, t,
  CASE series_id % 4 WHEN 0 THEN strptime('2024-01-01', '%Y-%m-%d') + to_days(t::INTEGER)
    WHEN 1 THEN TIMESTAMP '2020-02-01 00:00:00' + to_hours(t)
    WHEN 2 THEN TIMESTAMP '2021-03-01 00:00:00' + to_minutes(15 * t)
    ELSE TIMESTAMP '1900-01-01 00:00:00' + to_seconds(t) END AS ts FROM ud""")
def _(spark, d):
    s = user_day(spark, d)
    kind = F.pmod("series_id", F.lit(4))
    s = s.withColumns({
        "ts_text": F.when(kind == 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("t").cast("int")).cast("string")),
        "index_ts": F.when(kind == 1, F.lit("2020-02-01 00:00:00").cast("timestamp_ntz")
                           + F.make_interval(hours=F.col("t").cast("int"))),
        "start_ts": F.when(kind == 2, F.lit("2021-03-01 00:00:00").cast("timestamp_ntz")),
        "freq_seconds": F.when(kind == 2, 900)})
    return tables.resolve_time_index(s).select("dataset", "series_id", "t", "ts")


@query("all_datetimes", """SELECT lang, bool_and(try_cast(text AS TIMESTAMP) IS NOT NULL) AS text_is_datetime
  FROM documents GROUP BY 1""")
def _(spark, d):
    return tables.all_datetimes(table(spark, d, "documents"), ["lang"], "text").withColumnRenamed("is_datetime", "text_is_datetime")


@query("dataset_filter", f"""WITH {SM} SELECT sm.dataset, series_id, t, value FROM sm
  WHERE dataset IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    wanted = n.join(r, n.n_regionkey == r.r_regionkey).where("r_name = 'ASIA'").select(F.col("n_name").alias("dataset"))
    return tables.dataset_filter(supplier_month(spark, d), wanted)


@query("missing_datasets", f"WITH {SM} SELECT r_name AS dataset FROM region WHERE r_name NOT IN (SELECT dataset FROM sm)")
def _(spark, d):
    wanted = table(spark, d, "region").select(F.col("r_name").alias("dataset"))
    sm = supplier_month(spark, d)
    return tables.missing_datasets(sm, wanted.union(sm.select("dataset").distinct()))


@query("dataset_profile", f"""WITH {SM} SELECT dataset, n_series, length, n_series * length AS complexity FROM
  (SELECT dataset, count(DISTINCT series_id) AS n_series, count(DISTINCT t) AS length FROM sm GROUP BY 1)""")
def _(spark, d):
    return tables.dataset_profile(supplier_month(spark, d))


@query("persist_stage", f"""WITH {SM} SELECT dataset, series_id, sum(value) AS total FROM sm GROUP BY 1, 2""")
def _(spark, d):
    root = scratch_path(spark, "stages")
    sm = supplier_month(spark, d)
    build = lambda rows: rows.groupBy("dataset", "series_id").agg(F.sum("value").alias("total"))
    first = sm.where("dataset < 'NATION_2'")
    stages.persist_stage(build(first), root, "totals")
    # the second run computes only the data sets the stage lacks
    return stages.run_stage(sm, root, "totals", build).select("dataset", "series_id", "total")


@query("stage_missing", f"""WITH {SM} SELECT DISTINCT dataset FROM sm WHERE NOT dataset < 'NATION_2'""")
def _(spark, d):
    root = scratch_path(spark, "stages")
    sm = supplier_month(spark, d)
    stages.persist_stage(sm.where("dataset < 'NATION_2'").select("dataset", "series_id").distinct(), root, "ids")
    return stages.stage_missing(sm, root, "ids")


@query("write_recommendations", f"""WITH {SM} SELECT series_id, max(value) AS hi, min(value) AS lo FROM sm GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "recs")
    out = supplier_month(spark, d).groupBy("series_id").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    files.write_recommendations(out, path)
    return spark.read.option("sep", " ").option("header", True).schema("series_id bigint, hi double, lo double").csv(path)

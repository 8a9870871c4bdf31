"""Streaming jobs over the events and orders, cut into files by day or month."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.plans.correction import MIX, STEPS_SQL
from rollstat.plans.registry import query
from rollstat.plans.views import ROLL, q8, q8s, rounded, table, v_roll, with_ctes
from rollstat.session import shared_dir
from rollstat.streaming import jobs as J


def _files(spark, df, by: str, label: str):
    """The rows as files, one folder per value of ``by``: the arriving data of a stream."""
    path = shared_dir(spark, label)
    df.repartitionByRange(4, by).write.partitionBy(by).parquet(path)
    return path, df.drop(by).schema.add(by, df.schema[by].dataType)


def _events(spark, sf, per_batch=2):
    e = table(spark, sf, "events").withColumn("week", F.weekofyear("ts")).withColumn("ts", F.col("ts").cast("timestamp"))
    path, schema = _files(spark, e, "week", "events")
    return J.read_files(spark, path, schema, per_batch)


def _weeks(spark, df, label: str, *later):
    """The rows of one week after the other, then the further tables: files in the order of arrival."""
    path = shared_dir(spark, label)
    weeks = sorted(r[0] for r in df.select(F.date_trunc("week", "ts")).distinct().collect())  # a handful of weeks
    for week in weeks:
        df.filter(F.date_trunc("week", "ts") == F.lit(week)).repartition(4).write.mode("append").parquet(path)
    for more in later:
        more.repartition(4).write.mode("append").parquet(path)
    return path


@query("stream_score_rates", f"SELECT event_type, count(*)::BIGINT AS scored_rows, count(*) FILTER (value > 40)::BIGINT AS correct, {q8('count(*) FILTER (value > 40) / count(*)', 'live')} FROM events GROUP BY 1")
def stream_score_rates(spark, sf):
    return rounded(J.last_state(J.stream_score_rates(_events(spark, sf), "event_type", F.col("value") > 40), "score-rates", ["event_type"]), "live")


@query("stream_group_assembly", "SELECT CAST(user_id AS VARCHAR) AS uid, (count(*) // 8)::BIGINT AS n_groups, 8::INTEGER AS size FROM events GROUP BY 1 HAVING count(*) >= 8")
def stream_group_assembly(spark, sf):
    groups = J.stream_group_assembly(_events(spark, sf), "user_id", "ts", "value", 8, "60 days", late="60 days")
    out = J.collect_to_table(groups, "groups").filter("not dropped")
    return out.groupBy("uid").agg(F.count(F.lit(1)).alias("n_groups"), F.max("size").alias("size"))


@query("stream_group_members", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_id FROM events), c AS (SELECT uid, count(*) // 8 * 8 AS n FROM e GROUP BY 1)
SELECT uid, n::BIGINT AS members, n::BIGINT AS known FROM c WHERE n > 0""")
def stream_group_members(spark, sf):
    groups = J.stream_group_assembly(_events(spark, sf), "user_id", "ts", "value", 8, "60 days", late="60 days", member="event_id")
    members = J.collect_to_table(groups, "members").filter("not dropped").select("uid", F.explode("members").alias("event_id"))
    members = members.withColumn("event_id", F.col("event_id").cast("bigint")).distinct()
    owners = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("owner"))
    return members.join(owners, "event_id").groupBy("uid").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("owner") == F.col("uid")).alias("known"))


# groups of 3 responses, 12 hours of patience; every tenth old row comes weeks too late
@query("stream_group_timeouts", f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS uid, CAST(event_id AS VARCHAR) AS id, epoch_ms(ts) AS ms, value FROM events
 WHERE NOT (event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY)),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY uid ORDER BY ms, id) > 43200000 THEN 1 ELSE 0 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
n AS (SELECT *, (row_number() OVER (PARTITION BY uid, sid ORDER BY ms, id) - 1) // 3 AS part FROM s),
p AS (SELECT uid, sid, part, count(*) < 3 AS dropped, count(*) AS size, sum(value) AS score FROM n GROUP BY uid, sid, part)
SELECT uid, dropped, count(*)::BIGINT AS n_groups, sum(size)::BIGINT AS members, {q8('sum(score)', 'score')} FROM p GROUP BY uid, dropped""")
def stream_group_timeouts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts", "value")
    top = e.agg(F.max("ts").alias("m")).scalar()
    tardy = (F.col("event_id") % 10 == 0) & (F.col("ts") < top - F.expr("INTERVAL 20 DAYS"))
    end = e.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(0.0).alias("value"))
    path = _weeks(spark, e.filter(~tardy), "timeouts", e.filter(tardy), end)
    groups = J.stream_group_assembly(J.read_files(spark, path, e.schema, 4), "user_id", "ts", "value", 3, "12 hours", late="8 days", member="event_id")
    out = J.collect_to_table(groups, "timeouts").filter("uid <> '-1'")
    return rounded(out.groupBy("uid", "dropped").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum(F.size("members")).alias("members"), F.sum("score").alias("score")), "score")


@query("stream_mixture", f"WITH RECURSIVE {STEPS_SQL} SELECT day, event_type, t::INTEGER AS t, {q8s('raw', 'ema', 'gap', 'velocity', 'signal', 'mixture')} FROM fin")
def stream_mixture(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    # the mark of a far later row finishes the last steps
    end = e.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select("ts", F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    path = _weeks(spark, e, "mixture-files", end)
    # a reward is minus the value; a step is a day
    out = J.stream_mixture(J.read_files(spark, path, e.schema, 4), "ts", "1 day", "event_type", -F.col("value") / 100, "mixture", late="8 days", **MIX)
    out = out.select(F.to_date("step").alias("day"), F.col("domain").alias("event_type"), F.col("t").cast("int").alias("t"), "raw", "ema", "gap", "velocity", "signal", "mixture")
    return rounded(out, "raw", "ema", "gap", "velocity", "signal", "mixture")


# four rounds, quotas of 6, 6 and 4 groups, at most 3 rounds for a batch; go holds the state after each round
@query("stream_dynamic_sampling", """WITH RECURSIVE v AS (SELECT o_custkey AS uid, o_orderkey AS sample_id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS acc,
 (o_custkey % 8 // 2)::BIGINT AS round, 'd' || (o_custkey % 3) AS domain FROM orders),
u AS (SELECT uid, round, domain, count(*) = 1 OR min(acc) < max(acc) AS varies FROM v GROUP BY uid, round, domain),
c AS (SELECT r, count(*) FILTER (varies AND domain = 'd0' AND round = r) AS a, count(*) FILTER (varies AND domain = 'd1' AND round = r) AS b,
 count(*) FILTER (varies AND domain = 'd2' AND round = r) AS c FROM range(4) t(r) CROSS JOIN u GROUP BY r),
go(r, first, a, b, c, no, out, filtered) AS (SELECT -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, false
 UNION ALL SELECT r, CASE WHEN out THEN r ELSE first END, a, b, c, no + CASE WHEN out THEN 1 ELSE 0 END, full_ OR r - CASE WHEN out THEN r ELSE first END + 1 >= 3, full_ FROM
  (SELECT c.r, go.first, go.out, go.no, CASE WHEN go.out THEN 0 ELSE go.a END + c.a AS a, CASE WHEN go.out THEN 0 ELSE go.b END + c.b AS b, CASE WHEN go.out THEN 0 ELSE go.c END + c.c AS c,
   CASE WHEN go.out THEN 0 ELSE go.a END + c.a >= 6 AND CASE WHEN go.out THEN 0 ELSE go.b END + c.b >= 6 AND CASE WHEN go.out THEN 0 ELSE go.c END + c.c >= 4 AS full_
   FROM go JOIN c ON c.r = go.r + 1) z),
p AS (SELECT go.no, go.filtered, u.*, row_number() OVER (PARTITION BY go.no, domain ORDER BY u.round, sha256(CAST(uid AS VARCHAR))) AS place
 FROM go JOIN u ON go.out AND u.round BETWEEN CASE WHEN go.filtered THEN go.first ELSE go.r END AND go.r AND (u.varies OR NOT go.filtered))
SELECT p.no AS batch_no, p.filtered, p.round, p.domain, p.uid, v.sample_id, v.acc FROM p JOIN v USING (uid) WHERE place <= CASE p.domain WHEN 'd2' THEN 4 ELSE 6 END""")
def stream_dynamic_sampling(spark, sf):
    rows = v_roll(spark, sf).drop("step").withColumn("round", F.floor(F.col("uid") % 8 / 2)).withColumn("domain", F.concat(F.lit("d"), F.col("uid") % 3))
    path, place = shared_dir(spark, "rollouts"), J.Place.new(spark, "dynamic")
    for r in range(4):  # a round is what is there when the job goes on
        rows.filter(F.col("round") == r).drop("round").write.mode("append").parquet(path)
        out = J.stream_dynamic_sampling(
            J.read_files(spark, path, rows.drop("round").schema), "uid", "acc", "domain", {"d0": 6, "d1": 6, "d2": 4}, 3, "dynamic", place)
    return out.select("batch_no", "filtered", "round", "domain", "uid", "sample_id", "acc")


@query("stream_staleness_filter", """WITH c AS (SELECT event_type, max(json_extract_string(props, '$.k')::BIGINT) AS cur FROM events GROUP BY 1),
x AS (SELECT event_type, cur - json_extract_string(props, '$.k')::BIGINT AS lag FROM events JOIN c USING (event_type))
SELECT event_type, count(*)::BIGINT AS seen, count(*) FILTER (lag > 60)::BIGINT AS dropped, count(*) FILTER (lag BETWEEN 1 AND 60)::BIGINT AS stale_kept FROM x GROUP BY 1""")
def stream_staleness_filter(spark, sf):
    version = F.get_json_object("props", "$.k").cast("bigint")
    versions = table(spark, sf, "events").groupBy("event_type").agg(F.max(version).alias("current"))
    tagged = J.stream_staleness_filter(_events(spark, sf).withColumn("version", version), versions, "event_type", "version", 60)
    return J.last_state(J.staleness_counts(tagged, "event_type"), "staleness", ["event_type"])


@query("stream_step_metrics", f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type || CASE WHEN user_id % 2 = 0 THEN '/max' ELSE '/mean' END AS metric,
 {q8("CASE WHEN user_id % 2 = 0 THEN max(value) ELSE avg(value) END", 'value')} FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type, user_id % 2""")
def stream_step_metrics(spark, sf):
    log = _events(spark, sf).withColumn("metric", F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "/max").otherwise("/mean")))
    out = J.last_state(J.stream_step_metrics(log, "ts", "metric", "value", "1 hour", "40 days"), "step-metrics", ["start", "end", "metric"])
    out = out.select(F.col("start").cast("timestamp_ntz").alias("start"), "metric", "value")
    return rounded(out, "value")


@query("stream_sliding_metrics", f"""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * k) AS start FROM events, range(2) t(k))
SELECT start, event_type AS metric, {q8('avg(value)', 'value')}, count(*)::BIGINT AS n FROM w GROUP BY 1, 2""")
def stream_sliding_metrics(spark, sf):
    log = _events(spark, sf).select("ts", F.col("event_type").alias("metric"), "value")
    out = J.last_state(J.stream_step_metrics(log, "ts", "metric", "value", "24 hours", "40 days", slide="12 hours"), "sliding", ["start", "end", "metric"])
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "metric", "value", "n"), "value")


@query("stream_session_metrics", f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT min(ts) AS start, event_type || '/' || (user_id % 50) AS metric, {q8('avg(value)', 'value')}, count(*)::BIGINT AS n FROM s GROUP BY event_type, user_id % 50, sid""")
def stream_session_metrics(spark, sf):
    # sessions come out when the watermark closes them; the mark of a far later row closes the last
    end = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("ts")).select(
        (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit("end").alias("metric"), F.lit(0.0).alias("value"))
    place = J.Place.new(spark, "sessions")
    path = shared_dir(spark, "session-files")
    table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "event_type", F.col("user_id") % 50).alias("metric"), "value").write.parquet(path)
    run = lambda: J.collect_to_table(J.stream_step_metrics(J.read_files(spark, path, end.schema), "ts", "metric", "value", "6 hours", "1 day", session=True), "sessions", place=place)
    run()
    end.write.mode("append").parquet(path)
    out = run().filter("metric <> 'end'")  # goes on from the checkpoint
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "metric", "value", "n"), "value")

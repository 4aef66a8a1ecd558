"""Queries of streams and time windows (Z): streams are drained with availableNow and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupsight.functions.scalars import rounded
from groupsight.operators import features as G
from groupsight.plans.q_features import CONTRAST_SQL, HEURISTIC_SQL, group_sql, session_sql
from groupsight.plans.registry import query
from groupsight.sources.bindings import USER_EVENTS, table, user_events, vector_scores
from groupsight.plans.q_evaluate import ANSWERS_SQL, SC, THRESHOLD_SQL, answered, gap_sql
from groupsight.sources.store import cut, shared_path
from groupsight.streaming import jobs as Z
from groupsight.streaming import state as K


def _shown(df, *names):
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select(when("start"), when("end"), *names)


def _window_sql(seconds: int) -> str:
    return f"""SELECT strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, strftime(to_timestamp(s + {seconds}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean"""


@query("z_tumbling", f"{_window_sql(21600)} FROM (SELECT *, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS s FROM events) GROUP BY s, event_type")
def z_tumbling(spark, d):
    return _shown(Z.tumbling(table(spark, d, "events"), "ts", "6 hours"), "event_type", "n", rounded("mean").alias("mean"))


@query("z_sliding", f"{_window_sql(21600)} FROM (SELECT *, CAST(floor(epoch(ts) / 3600) * 3600 - k * 3600 AS BIGINT) AS s FROM events, range(6) x(k)) GROUP BY s, event_type")
def z_sliding(spark, d):
    return _shown(Z.sliding(table(spark, d, "events"), "ts", "6 hours", "1 hour"), "event_type", "n", rounded("mean").alias("mean"))


@query("z_stream_tumbling")
def z_stream_tumbling(spark, d):
    """The stream's own result: windows that the watermark has passed."""
    return Z.drained(Z.tumbling(Z.event_stream(spark, d, "events"), "ts", "6 hours"), "tumbling")


@query("z_epoch", """SELECT event_id, CAST(b AS BIGINT) AS begin, CAST(b + len - tt AS BIGINT) AS seconds_left FROM (SELECT *, tt - ((tt - z) % len + len) % len AS b FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS tt, CAST(epoch(TIMESTAMP '2024-01-15 20:00:00') AS BIGINT) AS z,
  CASE WHEN floor(epoch(ts)) >= epoch(TIMESTAMP '2024-01-15 20:00:00') THEN 259200 ELSE 86400 END AS len FROM events))""")
def z_epoch(spark, d):
    e = Z.epoch(table(spark, d, "events"), "ts", "2024-01-15 20:00:00")
    return e.select("event_id", F.unix_timestamp("epoch_start").alias("begin"), "seconds_left")


@query("z_session", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def z_session(spark, d):
    s = Z.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("z_served", f"""WITH c AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS cycle, count(*) AS n FROM events WHERE date_trunc('hour', ts) <= (SELECT max(date_trunc('hour', ts)) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2)
  SELECT user_id, cycle, CAST(sum(n) OVER w AS BIGINT) AS times, min(cycle) OVER w AS first_cycle, n > 1 OR row_number() OVER w > 1 AS repeated, least(64, row_number() OVER w) AS kept FROM c WINDOW w AS (PARTITION BY user_id ORDER BY cycle)""")
def z_served(spark, d):
    """Users served in hourly cycles; a cycle's rows have the time of its begin."""
    events = Z.event_stream(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("cycle"), F.date_trunc("hour", "ts").alias("ts"))
    out = Z.drained(K.served_stream(events, "user_id", "cycle", "ts"), "served")
    return out.select("user_id", "cycle", "times", "first_cycle", "repeated", F.size("kept_cycles").cast("long").alias("kept"))


#: When cycle 0 of the score streams began.
_BEGIN = 1_700_000_000


def _score_stream(spark, d):
    """Scores of a minute per cycle, in files that overlap by some cycles, two to a batch; a last row without a stream moves the clock past all others."""
    rows = cut(vector_scores(spark, d).select("scorer", "cycle", "score", F.timestamp_seconds(_BEGIN + F.col("cycle") * 60).alias("at"), F.floor((F.col("cycle") + F.col("id") % 3) / 4).alias("file")), "scores")
    path = Z.arriving(rows, "file", "scores")
    end = rows.agg((_BEGIN + F.max("cycle") * 60 + 3600).alias("s")).select(F.lit(None).cast("long").alias("scorer"), F.lit(None).cast("long").alias("cycle"), F.lit(None).cast("double").alias("score"), F.timestamp_seconds("s").alias("at"))
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("scorer long, cycle long, score double, at timestamp").option("maxFilesPerTrigger", 2).parquet(path)


@query("z_threshold", THRESHOLD_SQL)
def z_threshold(spark, d):
    """The stream's thresholds are those of the whole table of scores in order."""
    out = Z.drained(K.threshold_stream(_score_stream(spark, d), "scorer", "cycle", "score", "at", "5 minutes"), "thresholds")
    return out.select("scorer", "cycle", rounded("threshold").alias("threshold"), "mode")


@query("z_monitor", f"""{SC}, rq AS (SELECT scorer, cycle, row_number() OVER (PARTITION BY scorer ORDER BY cycle) AS k FROM (SELECT DISTINCT scorer, cycle FROM sc)),
  wi AS (SELECT q.scorer, q.cycle, s.score FROM rq q JOIN sc s ON s.scorer = q.scorer AND s.cycle <= q.cycle WHERE k % 5 = 0 QUALIFY row_number() OVER (PARTITION BY q.scorer, q.cycle ORDER BY s.cycle DESC, s.score DESC) <= 200),
  {gap_sql("wi", "gm", 20, 5, 0.01, 0)}, lo AS (SELECT scorer, cycle, count(*) AS n, median(score) FILTER (score >= threshold) AS upper, CASE WHEN max(threshold) IS NULL THEN median(score) ELSE median(score) FILTER (score < threshold) END AS lower
    FROM wi JOIN gm USING (scorer, cycle) GROUP BY 1, 2 HAVING count(*) >= 20), la AS (SELECT *, lag(upper) OVER w AS was, row_number() OVER w > 1 AS looked FROM lo WINDOW w AS (PARTITION BY scorer ORDER BY cycle))
  SELECT scorer, cycle, n, round(upper, 6) AS upper, round(lower, 6) AS lower, CASE WHEN NOT looked THEN NULL WHEN upper IS NULL AND was IS NOT NULL THEN 'lost' WHEN upper IS NOT NULL AND was IS NULL THEN 'found' WHEN abs(upper - was) > 0.15 THEN 'moved' END AS alert FROM la""")
def z_monitor(spark, d):
    out = Z.drained(K.monitor_stream(_score_stream(spark, d), "scorer", "cycle", "score", "at", "5 minutes"), "alerts")
    return out.select("scorer", "cycle", "n", rounded("upper").alias("upper"), rounded("lower").alias("lower"), "alert")


@query("z_log", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def z_log(spark, d):
    once = Z.drained(Z.deduplicated_log(Z.event_stream(spark, d, "events"), "ts", "event_id", "400 days"), "log")
    return once.groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"))


@query("z_coverage", f"WITH {ANSWERS_SQL} SELECT user_id, cycle, round(coverage, 6) + 0.0 AS coverage FROM cv")
def z_coverage(spark, d):
    """Each user's coverage of each daily cycle, 0 where no answer came."""
    return answered(spark, d)[1].select("user_id", "cycle", rounded("coverage").alias("coverage"))


@query("z_score_log", f"WITH {USER_EVENTS},{session_sql('b2')},{group_sql()},{CONTRAST_SQL} SELECT grp, CAST(chunk_n_hands AS BIGINT) AS sessions, round(raise_ratio_mean, 6) + 0.0 AS raise_ratio_mean, round({HEURISTIC_SQL}, 5) AS score FROM cf")
def z_score_log(spark, d):
    """Users' events arrive as messages, some twice; features and score are logged once per user."""

    def scored(messages):
        events = messages.select(F.inline("events"))
        g = G.contrast_features(G.group_features(G.session_features(events)))
        return g.select("grp", F.col("chunk_n_hands").cast("long").alias("sessions"), rounded("raise_ratio_mean").alias("raise_ratio_mean"), rounded(G.heuristic_score(g), 5).alias("score"))

    path, events = shared_path(spark, "requests"), user_events(spark, d)
    # a message per user, and some of them once more
    messages = events.groupBy(F.col("grp").alias("user")).agg(F.collect_list(F.struct(*events.columns)).alias("events")).withColumn("at", F.timestamp_seconds(_BEGIN + F.col("user") % 600))
    messages = cut(messages, "messages")
    messages.write.parquet(path)
    messages.where("user % 3 = 0").write.mode("append").parquet(path)
    return Z.score_log(spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(path), scored, "user", "at")

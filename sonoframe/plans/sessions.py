"""Queries of session control and of load tests, with ``events`` as messages, controls and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.operators import messages, metrics, session
from sonoframe.params import Params
from sonoframe.plans.registry import query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


SQL_KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' ELSE 'frame' END"


@query("asof_hotwords", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS props_as_of
FROM events QUALIFY event_type <> 'signup'""")  # fmt: skip
def asof_hotwords(spark, sf_dir):
    df = events(spark, sf_dir)
    controls = df.where("event_type = 'signup'").select("user_id", "ts", F.col("props").alias("props"))
    asked = df.where("event_type <> 'signup'").select("user_id", "ts", "event_id")
    return session.as_of(asked, controls, "user_id", "ts", ["props"]).select("event_id", "props_as_of")


@query("started_frames", f"""
WITH m AS (SELECT *, {SQL_KIND} AS kind FROM events),
w AS (SELECT *, max((kind = 'start')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS on_,
  coalesce(sum((kind = 'start')::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS again,
  coalesce(max((kind = 'stop')::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m)
SELECT event_id, kind FROM w WHERE on_ = 1 AND off = 0 AND NOT (kind = 'start' AND again > 0)""")  # fmt: skip
def started_frames(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop").otherwise("frame")
    return session.started(events(spark, sf_dir).withColumn("kind", kind), "user_id", "ts", F.col("kind")).select("event_id", "kind")


@query("enrollment_join", "SELECT e.event_id, c.c_name AS enrolled FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE c.c_acctbal > 0")
def enrollment_join(spark, sf_dir):
    enrolled = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("enrolled"))
    return session.with_enrollment(events(spark, sf_dir).select("event_id", "user_id"), enrolled, "user_id").select("event_id", "enrolled")


@query("latest_partial", """
SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m""")  # fmt: skip
def latest_partial(spark, sf_dir):
    return session.latest_wins(events(spark, sf_dir), "user_id", "ts", "value").select("event_id")


@query("history_top8", "SELECT event_id, place::INT AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 8")
def history_top8(spark, sf_dir):
    return session.newest(events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "place")


@query("bounded_queue", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 40")
def bounded_queue(spark, sf_dir):
    return session.bounded_queue(events(spark, sf_dir), "user_id", ["ts", "event_id"], Params().queue_size).select("event_id")


@query("running_hits", "SELECT event_id, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS total_hits FROM events")
def running_hits(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("hits", F.when(F.col("value") > 100, 1).otherwise(0))
    return session.running_hits(df, "user_id", ["ts", "event_id"], "hits").select("event_id", "total_hits")


@query("emotion_response_join", """
SELECT a.event_id, b.label AS emotion FROM events a LEFT JOIN (SELECT event_id, event_type AS label FROM events WHERE value > 200) b USING (event_id)""")  # fmt: skip
def emotion_response_join(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.select("event_id").join(df.where("value > 200").select("event_id", F.col("event_type").alias("emotion")), "event_id", "left")


@query("emotion_messages", """
SELECT event_id, '{"type":"final_emotion","mode":"ser","label":"' || event_type || '","text":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"raw_text":"x"' ELSE '' END || '}' AS message FROM events""")  # fmt: skip
def emotion_messages(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, "x").otherwise(F.col("event_type"))
    made = messages.emotion_final(F.lit("ser"), F.col("event_type"), F.col("event_type"), raw, F.lit(""), F.lit(None).cast("double"))
    return events(spark, sf_dir).select("event_id", made.alias("message"))


@query("target_messages", """
SELECT event_id, '{"type":"final","id":"tsasr-' || substr(md5(user_id::VARCHAR), 1, 8) || '-' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) || '","text":"' || event_type || '","language":"English","task":"tsasr"}' AS message
FROM events WHERE event_type <> 'error'""")  # fmt: skip
def target_messages(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("text", F.when(F.col("event_type") != "error", F.col("event_type")))
    df = session.numbered_outputs(df, "user_id", ["ts", "event_id"])
    none = F.lit(None)
    return df.select("event_id", messages.target_final(F.col("user_id"), F.col("ordinal"), F.col("text"), F.lit("English"), none.cast("string"), none.cast("double")).alias("message"))


SQL_LEVELS = """levels AS (SELECT event_type, user_id % 8 AS level, count(*) AS n_total, count(*) FILTER (value > 20) AS n_ok, quantile_cont(value, 0.5) FILTER (value > 20) AS p50, quantile_cont(value, 0.9) FILTER (value > 20) AS p90, quantile_cont(value, 0.99) FILTER (value > 20) AS p99, avg(value) FILTER (value > 20) AS mean, sum(CASE WHEN value > 20 THEN event_id % 10 END) AS tok FROM events GROUP BY ALL)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("level", F.col("user_id") % 8)
    return metrics.level_stats(df, ["event_type", "level"], ok=F.col("value") > 20, latency=F.col("value"), audio_sec=F.lit(50.0), tokens=F.col("event_id") % 10, wall_sec=F.lit(60.0))


@query("bench_levels", f"WITH {SQL_LEVELS} SELECT event_type, level, n_total, n_ok, n_total - n_ok AS n_err, round(p50, 6) AS lat_p50, round(p90, 6) AS lat_p90, round(p99, 6) AS lat_p99, round(mean, 6) AS lat_mean, round(p50 / 50, 6) AS rtf_p50, round(p90 / 50, 6) AS rtf_p90, round(n_ok / 60, 6) AS req_per_s, round(n_ok * 50.0::DOUBLE / 60, 6) AS audio_s_per_s, round(tok / 60, 6) AS tok_per_s FROM levels")
def bench_levels(spark, sf_dir):
    df = levels(spark, sf_dir)
    return df.select("event_type", "level", "n_total", "n_ok", "n_err", *[F.round(c, 6).alias(c) for c in df.columns[5:]])


@query("error_rate", f"WITH {SQL_LEVELS} SELECT event_type, level, round((n_total - n_ok) / greatest(1, n_total), 9) AS error_rate FROM levels")
def error_rate(spark, sf_dir):
    df = metrics.counts(events(spark, sf_dir).withColumn("level", F.col("user_id") % 8), ["event_type", "level"], F.col("value") > 20)
    return df.select("event_type", "level", F.round(metrics.error_rate(F.col("n_err"), F.col("n_total")), 9).alias("error_rate"))


@query("bench_early_stop", f"WITH {SQL_LEVELS} SELECT event_type, level FROM (SELECT *, coalesce(max((p50 / 50 > 1.0 OR (n_total - n_ok) / greatest(1, n_total) > 0.05)::INT) OVER (PARTITION BY event_type ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM levels) WHERE o = 0")
def bench_early_stop(spark, sf_dir):
    df = levels(spark, sf_dir).withColumn("error_rate", metrics.error_rate(F.col("n_err"), F.col("n_total")))
    return metrics.until_overload(df, "event_type", "level").select("event_type", "level")


@query("bench_requests", "SELECT event_id, least(200, greatest(20, 5 * (event_id % 64)))::BIGINT AS n FROM events")
def bench_requests(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", metrics.request_count(F.col("event_id") % 64).alias("n"))


@query("bench_first_errors", "SELECT event_type, event_id, place::INT AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events WHERE value <= 20) WHERE place <= 5")
def bench_first_errors(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("error", F.when(F.col("value") <= 20, "slow"))
    return metrics.first_errors(df, ["event_type"], "event_id", "error").select("event_type", "event_id", "place")


@query("rtf", "SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value / (event_id % 5) END, 9) AS rtf FROM events")
def rtf(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(metrics.real_time_factor(F.col("value"), (F.col("event_id") % 5).cast("double")), 9).alias("rtf"))


@query("config_override", "SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 0.7::DOUBLE ELSE 0.65::DOUBLE END AS speech_threshold, event_type <> 'view' AS gate_enabled FROM events")
def config_override(spark, sf_dir):
    changes = {"click": {"speech_threshold": "0.7", "unknown": 1}, "view": {"gate_enabled": "false"}}
    df = events(spark, sf_dir).select("event_type").distinct()
    of = lambda name: {k: getattr(Params().override(v), name) for k, v in changes.items()}
    pick = lambda name: F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in of(name).items()], F.lit(getattr(Params(), name)))
    return df.select("event_type", pick("speech_threshold").alias("speech_threshold"), pick("gate_enabled").alias("gate_enabled"))

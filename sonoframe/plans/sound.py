"""Queries over sound itself: chunks of bytes to segments, long sessions in chunks, decimation, words in texts, a load test's report.

A user of ``events`` is a session and each event a chunk: a stretch of equal samples, loud if its value is high.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.operators import long_sessions, mentions, metrics, streams, table_functions
from sonoframe.params import Params
from sonoframe.plans.frames import ORDER, RULES, SQL_MACHINE, frames, sql
from sonoframe.plans.registry import query, table
from sonoframe.sources.scratch import shared_folder

#: Frames of 40 samples, segments of four or more.
PARAMS = Params().override({"hop": 40, "min_segment_ms": 10})
LOUD = 55
CAP = 900

SQL_SAMPLES = f"""chunks AS (SELECT user_id, ts, event_id, 40 + event_id % 97 AS n, CASE WHEN value > {LOUD} THEN 4000 + event_id % 1000 ELSE 0 END AS v FROM events),
laid AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) - n AS begins FROM chunks),
samples AS (SELECT user_id, begins + k AS i, v FROM laid, unnest(range(n::BIGINT)) AS t(k)),
frames AS (
  SELECT user_id, (i // {PARAMS.hop})::BIGINT AS i, least(1.0, greatest(0.0, (sqrt(avg((v / 32768.0) ** 2)) - {au.FLOOR}) / {au.CEILING - au.FLOOR}))::DOUBLE AS p
  FROM samples GROUP BY ALL HAVING count(*) = {PARAMS.hop})"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.lit(40) + F.col("event_id") % 97, F.when(F.col("value") > LOUD, 4000 + F.col("event_id") % 1000).otherwise(0)
    # two bytes a sample, the low one first
    sample = F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.unhex(F.repeat(sample, n.cast("int"))).alias("payload"))


def sums_of(pcm: bytes) -> tuple[int, int, int]:
    x = np.frombuffer(pcm, "<i2").astype(np.int64)
    return len(x), int(x.sum()), int(x @ np.arange(1, len(x) + 1))


def with_sums_of(batch: pd.DataFrame) -> pd.DataFrame:
    # one clip at a time: wide samples of a whole batch take many times its bytes
    sums = [sums_of(p) for p in batch["pcm"]]
    return batch.drop(columns="pcm").assign(n_samples=[n for n, _, _ in sums], total=[t for _, t, _ in sums], weighted=[w for _, _, w in sums])


def with_sums(found: DataFrame) -> DataFrame:
    """``found`` with how many samples it has and sums that tell what they are and where, in place of ``pcm``."""

    def add(batches):
        yield from map(with_sums_of, batches)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "pcm")
    return found.mapInPandas(add, f"{kept}, n_samples long, total long, weighted long")


SQL_HEARD = f"""WITH RECURSIVE {SQL_SAMPLES}, {SQL_MACHINE},
long_enough AS (SELECT * FROM segments WHERE is_flush OR (end_frame - start_frame + 1) * {PARAMS.hop} >= {int(PARAMS.sample_rate * PARAMS.min_segment_ms / 1000)}),
cut AS (SELECT user_id, seg_seq, f AS frame FROM long_enough, unnest(range(start_frame, end_frame + 1)) AS t(f))
SELECT g.user_id, g.seg_seq, g.start_frame, g.end_frame, g.is_flush, count(*) AS n_samples, sum(s.v)::BIGINT AS total, sum(s.v * (s.i - g.start_frame * {PARAMS.hop} + 1))::BIGINT AS weighted
FROM long_enough g JOIN cut c ON c.user_id = g.user_id AND c.seg_seq = g.seg_seq JOIN samples s ON s.user_id = c.user_id AND s.i // {PARAMS.hop} = c.frame GROUP BY ALL"""


@query("segments_of_sound", SQL_HEARD)
def segments_of_sound(spark, sf_dir):
    """Speech segments with their samples, from chunks that end anywhere: the batch twin of live sessions."""
    found = streams.heard(chunks(spark, sf_dir), lambda: streams.SegmentStream(RULES, PARAMS), session="user_id", order=ORDER)
    return with_sums(found)


@query("table_function_segments", SQL_HEARD)
def table_function_segments(spark, sf_dir):
    """The same through a table function that SQL calls."""
    table_functions.register(spark, RULES, PARAMS, session_type="bigint")
    rows = chunks(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    found = spark.sql("SELECT * FROM speech_segments(TABLE({rows}) PARTITION BY session_id ORDER BY (ts, event_id))", rows=rows)
    return with_sums(found.withColumnRenamed("session_id", "user_id"))


@query("table_function_utterances", f"""WITH {SQL_SAMPLES}, sized AS (SELECT user_id, max(i) + 1 AS n FROM samples GROUP BY user_id)
SELECT s.user_id, count(*) AS n_samples, sum(v)::BIGINT AS total, sum(v * (i - greatest(0, n - {CAP}) + 1))::BIGINT AS weighted
FROM samples s JOIN sized z ON z.user_id = s.user_id WHERE i >= n - {CAP} GROUP BY s.user_id""")  # fmt: skip
def table_function_utterances(spark, sf_dir):
    """Each session as one piece, its last samples only, through a table function."""
    spark.udtf.register("capped_utterances", table_functions.table_function(lambda: streams.UtteranceStream(PARAMS, CAP / PARAMS.sample_rate), "bigint"))
    rows = chunks(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    found = spark.sql("SELECT session_id AS user_id, pcm FROM capped_utterances(TABLE({rows}) PARTITION BY session_id ORDER BY (ts, event_id))", rows=rows)
    return with_sums(found)


@query("segments_by_chunks", sql("SELECT user_id, seg_seq, start_frame, end_frame, is_flush FROM segments"))
def segments_by_chunks(spark, sf_dir):
    """Speech segments of sessions cut into chunks that run at the same time."""
    numbered = frames(spark, sf_dir).withColumn("frame_idx", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1)
    return long_sessions.segments(numbered, RULES, session="user_id", chunk=16, warm=8)


SQL_TAPS = "[" + ", ".join(repr(float(t)) for t in au.low_pass()) + "]"


@query("decimated_samples", f"""
WITH vectors AS (SELECT vec_id // 40 AS session_id, vec_id, embedding, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) - 1 AS place FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
samples AS (SELECT session_id, place * 64 + k AS i, embedding[k + 1]::DOUBLE AS x FROM vectors, unnest(range(64)) AS t(k)),
taps AS (SELECT k, ({SQL_TAPS})[k + 1] AS t FROM unnest(range({au.TAPS})) AS u(k)),
sized AS (SELECT session_id, count(*) // 3 AS n FROM samples GROUP BY session_id)
SELECT z.session_id, m, round(sum(s.x * taps.t), 6) AS y FROM sized z, unnest(range(z.n)) AS o(m) CROSS JOIN taps JOIN samples s ON s.session_id = z.session_id AND s.i = 3 * m - taps.k GROUP BY ALL""")  # fmt: skip
def decimated_samples(spark, sf_dir):
    """Every third low-passed sample of sessions that come in chunks of 64."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) = 64").select(F.floor(F.col("vec_id") / 40).alias("session_id"), "vec_id", "embedding")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("vec_id")).cast("long") - 1)
    samples = placed.select("session_id", "place", F.posexplode("embedding").alias("k", "x")).select("session_id", (F.col("place") * 64 + F.col("k")).alias("i"), "x")
    made = au.decimated(samples, block=256)
    return made.select("session_id", "m", F.round("y", 6).alias("y"))


SQL_MENTIONS = """
WITH words AS (SELECT DISTINCT substr(text, 1 + item_id % 7, 3 + item_id % 9) AS word FROM benchmark WHERE text IS NOT NULL UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
SELECT DISTINCT d.doc_id, w.word FROM documents d JOIN words w ON w.word <> '' AND contains(d.text, w.word)"""


def sought(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.substring("text", F.col("item_id").cast("int") % 7 + 1, F.col("item_id").cast("int") % 9 + 3).alias("word"))
    return cut.union(table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang")).distinct()


@query("word_mentions", SQL_MENTIONS)
def word_mentions(spark, sf_dir):
    """Which words of a table stand in which documents, by an automaton."""
    return mentions.mentions(table(spark, sf_dir, "documents"), sought(spark, sf_dir))


@query("word_mentions_by_grams", SQL_MENTIONS)
def word_mentions_by_grams(spark, sf_dir):
    """The same by joins on each word's rarest q-gram, as for tables of any size."""
    return mentions.mentions(table(spark, sf_dir, "documents"), sought(spark, sf_dir), most_letters=0)


REPORT = "user_id long, n_total long, n_ok long, n_err long, lat_p50 double, lat_p90 double, lat_p99 double, sample_output string, errors array<string>"


@query("load_report", """
WITH r AS (SELECT user_id % 8 AS user_id, event_id, value, CASE WHEN event_id % 6 = 0 THEN 'failed ' || event_id END AS error FROM events),
l AS (SELECT user_id, count(*) AS n_total, count(*) FILTER (WHERE error IS NULL) AS n_ok, count(*) FILTER (WHERE error IS NOT NULL) AS n_err,
  quantile_cont(value, 0.5) FILTER (WHERE error IS NULL) AS lat_p50, quantile_cont(value, 0.9) FILTER (WHERE error IS NULL) AS lat_p90, quantile_cont(value, 0.99) FILTER (WHERE error IS NULL) AS lat_p99,
  'said ' || min(event_id) FILTER (WHERE error IS NULL) AS sample_output, sum(value) FILTER (WHERE error IS NULL) AS latencies FROM r GROUP BY user_id),
e AS (SELECT user_id, string_agg(error, '|' ORDER BY event_id) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM r WHERE error IS NOT NULL) WHERE k <= 5 GROUP BY user_id)
SELECT l.user_id, n_total, n_ok, n_err, round(lat_p50, 6) AS lat_p50, round(lat_p90, 6) AS lat_p90, round(lat_p99, 6) AS lat_p99, sample_output, coalesce(errors, '') AS errors, round(latencies, 4) AS latencies, 'ser' AS mode
FROM l LEFT JOIN e ON e.user_id = l.user_id""")  # fmt: skip
def load_report(spark, sf_dir):
    """A load test's report, written and read back."""
    error = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("failed "), "event_id"))
    requests = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("user_id"), "event_id", "value", error.alias("error"), F.concat(F.lit("said "), "event_id").alias("output"))
    ok, one = F.col("error").isNull(), F.lit(1.0)
    levels = metrics.level_stats(requests, ["user_id"], ok=ok, latency=F.col("value"), audio_sec=one, tokens=one, wall_sec=one)
    path = f"{shared_folder(spark)}/load-report-{pd.Timestamp.now().value}"
    metrics.report(requests, levels, {"mode": "ser"}, by=["user_id"], order="event_id", ok=ok, latency="value", error="error", output="output", path=path)
    config, told, raw = metrics.read_report(spark, path, REPORT)
    sums = raw.groupBy("user_id").agg(F.round(F.sum("latency"), 4).alias("latencies"))
    shown = told.select("user_id", "n_total", "n_ok", "n_err", *[F.round(c, 6).alias(c) for c in ("lat_p50", "lat_p90", "lat_p99")], "sample_output", F.array_join("errors", "|").alias("errors"))
    return shown.join(sums, "user_id").withColumn("mode", F.lit(config["mode"]))

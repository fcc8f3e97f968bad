"""Queries over frame streams. Users of ``events`` stand for sessions, their events in order of time for frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import audio
from sonoframe.operators import vad
from sonoframe.params import Params
from sonoframe.plans.registry import query, table

RULES = vad.event_rules()
ORDER = ["ts", "event_id"]
TARGET = 6

SQL_FRAMES = """frames AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(1.0, value / 100)::DOUBLE AS p FROM events)"""

SQL_EMA = f"""ema AS (
  SELECT user_id, i, p AS e FROM frames WHERE i = 0
  UNION ALL SELECT f.user_id, f.i, {RULES.smoothing}::DOUBLE * a.e + {1 - RULES.smoothing}::DOUBLE * f.p FROM ema a JOIN frames f ON f.user_id = a.user_id AND f.i = a.i + 1)"""

#: The state after each frame: mean, whether in a segment, counts, ring, start, and the segment that the frame closed.
SQL_MACHINE = f"""begun AS (SELECT user_id, min(i) AS i FROM frames GROUP BY user_id),
run AS (
  SELECT user_id, -1::BIGINT AS i, NULL::DOUBLE AS e, false AS on_, 0 AS cnt, 0 AS sil, 0 AS ring, 0::BIGINT AS start, NULL::BIGINT AS s0, NULL::BIGINT AS s1, NULL::DOUBLE AS mean FROM begun
  UNION ALL
  SELECT user_id, i, CASE WHEN closes THEN NULL ELSE e END, CASE WHEN closes THEN false ELSE on_ OR opens END, CASE WHEN closes THEN 0 ELSE cnt END, CASE WHEN closes OR opens THEN 0 ELSE sil END,
         CASE WHEN closes THEN 0 ELSE ring END, CASE WHEN opens THEN i - ring + 1 ELSE start END, CASE WHEN closes THEN start END, CASE WHEN closes THEN i - {RULES.end - min(RULES.keep_tail, RULES.end)} END, CASE WHEN closes THEN 0.0 ELSE e END
  FROM (
    SELECT *, NOT on_ AND cnt >= {RULES.start} AS opens, on_ AND sil >= {RULES.end} AS closes FROM (
      SELECT user_id, i, e, on_, start, CASE WHEN on_ THEN cnt WHEN e > {RULES.threshold} THEN cnt + 1 ELSE 0 END AS cnt, CASE WHEN NOT on_ OR e > {RULES.threshold} THEN 0 ELSE sil + 1 END AS sil, CASE WHEN on_ THEN ring ELSE least(ring + 1, {RULES.ring}) END AS ring
      FROM (SELECT f.user_id, f.i, CASE WHEN r.e IS NULL THEN f.p ELSE {RULES.smoothing}::DOUBLE * r.e + {1 - RULES.smoothing}::DOUBLE * f.p END AS e, r.on_, r.cnt, r.sil, r.ring, r.start
            FROM run r JOIN frames f ON f.user_id = r.user_id AND f.i = r.i + 1)))),
ends AS (SELECT user_id, max(i) AS last FROM frames GROUP BY user_id),
segs AS (
  SELECT user_id, s0 AS start_frame, s1 AS end_frame, false AS is_flush FROM run WHERE s0 IS NOT NULL
  UNION ALL SELECT r.user_id, r.start, r.i, true FROM run r JOIN ends e ON r.user_id = e.user_id AND r.i = e.last WHERE r.on_),
segments AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) - 1 AS seg_seq FROM segs)"""


def sql(body: str) -> str:
    return f"WITH RECURSIVE {SQL_FRAMES}, {SQL_MACHINE} {body}"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.segments(frames(spark, sf_dir), RULES, session="user_id", order=ORDER)


@query("ema_smooth", f"WITH RECURSIVE {SQL_FRAMES}, {SQL_EMA} SELECT user_id, i AS frame_idx, e AS ema FROM ema")
def ema_smooth(spark, sf_dir):
    return vad.smoothed(frames(spark, sf_dir), RULES.smoothing, session="user_id", order=ORDER)


@query("vad_segments", sql("SELECT user_id, seg_seq, start_frame, end_frame, is_flush FROM segments"))
def vad_segments(spark, sf_dir):
    return found(spark, sf_dir)


@query("speech_presence", sql("SELECT user_id, count(*) * 0.01 AS total_sec, count(*) FILTER (mean > 0.6) * 0.01 AS voiced_sec, round(avg(mean), 9) AS mean_prob, round(count(*) FILTER (mean > 0.6)::DOUBLE / count(*), 9) AS voiced_ratio FROM run WHERE i >= 0 GROUP BY user_id").replace("* 0.01", "* 0.01::DOUBLE"))
def speech_presence(spark, sf_dir):
    got = vad.speech_presence(frames(spark, sf_dir), RULES, 0.6, 0.01, session="user_id", order=ORDER)
    return got.withColumns({"mean_prob": F.round("mean_prob", 9), "voiced_ratio": F.round("voiced_ratio", 9)})


@query("speech_gate", sql("SELECT user_id, count(*) FILTER (mean > 0.6) * 0.01::DOUBLE * 1000 >= 200 AS kept FROM run WHERE i >= 0 GROUP BY user_id"))
def speech_gate(spark, sf_dir):
    got = vad.speech_presence(frames(spark, sf_dir), RULES, 0.6, 0.01, session="user_id", order=ORDER)
    return got.select("user_id", vad.passes_gate(F.col("voiced_sec"), Params()).alias("kept"))


@query("min_segment_filter", sql("SELECT user_id, seg_seq FROM segments WHERE is_flush OR (end_frame - start_frame + 1) * 1000 >= 5600"))
def min_segment_filter(spark, sf_dir):
    size = (F.col("end_frame") - F.col("start_frame") + 1) * 1000
    return found(spark, sf_dir).where(vad.long_enough(size, F.col("is_flush"), Params())).select("user_id", "seg_seq")


@query("partial_snapshots", sql("SELECT user_id, seg_seq, start_frame, start_frame + 3 + 2 * k AS upto_frame FROM segments, LATERAL (SELECT unnest(range(0, CASE WHEN end_frame - start_frame + 1 >= 4 THEN (end_frame - start_frame - 3) // 2 + 1 ELSE 0 END)) AS k)"))
def partial_snapshots(spark, sf_dir):
    return vad.partial_snapshots(frames(spark, sf_dir), found(spark, sf_dir), 2, 4, session="user_id")


@query("voiced_trim", sql(f"""
, sized AS (SELECT *, end_frame - start_frame + 1 AS n, coalesce(sum(end_frame - start_frame + 1) OVER (PARTITION BY user_id ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM segments),
cut AS (SELECT user_id, start_frame, end_frame, least(n, {TARGET} - before)::BIGINT AS kept FROM sized JOIN ends USING (user_id) WHERE before < {TARGET} AND last + 1 > {TARGET})
SELECT * FROM cut UNION ALL SELECT user_id, 0, least(last + 1, {TARGET}) - 1, least(last + 1, {TARGET}) FROM ends WHERE user_id NOT IN (SELECT user_id FROM cut)"""))  # fmt: skip
def voiced_trim(spark, sf_dir):
    totals = frames(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_frames"))
    return vad.voiced_trim(found(spark, sf_dir), totals, TARGET, session="user_id")


@query("tail_cap", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def tail_cap(spark, sf_dir):
    return vad.tail_cap_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ORDER, 5).select("user_id", "event_id")


@query("tail_cap_vector", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[len(embedding) - 15:], lambda x: x::DOUBLE * x::DOUBLE)) / 16), 6) AS rms FROM embeddings")
def tail_cap_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.rms(vad.tail_cap(F.col("embedding"), 16)), 6).alias("rms"))


@query("head_cap", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)) / 16), 6) AS rms FROM embeddings")
def head_cap(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.rms(vad.head_cap(F.col("embedding"), 16)), 6).alias("rms"))


@query("pre_speech_ring", "SELECT event_id, len(r)::INT AS n, round(list_sum(r), 6) AS total FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS r FROM events)")
def pre_speech_ring(spark, sf_dir):
    got = vad.pre_speech_ring(table(spark, sf_dir, "events"), "user_id", ORDER, "value", 4)
    return got.select("event_id", F.size("ring").alias("n"), F.round(F.aggregate("ring", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("speech_runs", """
SELECT event_id, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id)::BIGINT AS run FROM (
  SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, value > 50 AS f FROM events))""")  # fmt: skip
def speech_runs(spark, sf_dir):
    return vad.run_counter(table(spark, sf_dir, "events"), "user_id", ORDER, F.col("value") > 50).select("event_id", "run")


@query("frame_energy", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS energy FROM embeddings")
def frame_energy(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.rms(F.col("embedding")), 6).alias("energy"))


@query("float_to_pcm16", "SELECT event_id, CASE WHEN s < 0 THEN trunc(s * 32768) ELSE trunc(s * 32767) END::INT AS sample FROM (SELECT event_id, greatest(-1.0, least(1.0, (value - 50) / 100))::DOUBLE AS s FROM events)")
def float_to_pcm16(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", audio.float_to_pcm16((F.col("value") - 50) / 100).alias("sample"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each vector: its components as samples."""

    def make(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "content": [audio.wav(x) for x in b["embedding"]]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(make, "vec_id long, content binary")


@query("wav_roundtrip", "SELECT vec_id, (44 + 2 * len(embedding))::INT AS wav_bytes, len(embedding)::BIGINT AS n_samples, list_sum(list_transform(embedding, lambda x: trunc((trunc(greatest(-32768.0, least(32767.0, (x * 32767::FLOAT)::FLOAT)))::FLOAT / 32768::FLOAT * 32767::FLOAT)::FLOAT)))::BIGINT AS total FROM embeddings")
def wav_roundtrip(spark, sf_dir):
    """Samples written as a WAV file and decoded from it, scaled once each way."""
    got = clips(spark, sf_dir).select("vec_id", F.octet_length("content").alias("wav_bytes"), audio.decode_wav("content").alias("d"))

    def add(batches):
        import numpy as np

        for b in batches:
            samples = [np.frombuffer(bytes(x), "<i2").astype(np.int64) for x in b["pcm"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "wav_bytes": b["wav_bytes"], "n_samples": [len(x) for x in samples], "total": [int(x.sum()) for x in samples]})

    return got.where("d.error IS NULL").select("vec_id", "wav_bytes", "d.pcm").mapInPandas(add, "vec_id long, wav_bytes int, n_samples long, total long")


@query("resample_linear")
def resample_linear(spark, sf_dir):
    """Each vector as sound at 48 kHz, brought to 16 kHz by the low-pass and by straight lines."""

    def both(batches):
        import numpy as np

        for b in batches:
            sound = [np.repeat(np.asarray(x, np.float32), 12) for x in b["embedding"]]
            low, line = [audio.Decimator().feed(x) for x in sound], [audio.resample(x, 48_000) for x in sound]
            yield pd.DataFrame({"vec_id": b["vec_id"], "n_low": [len(x) for x in low], "n_line": [len(x) for x in line], "rms_low": [float(np.sqrt((x**2).mean())) for x in low], "rms_line": [float(np.sqrt((x**2).mean())) for x in line]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(both, "vec_id long, n_low long, n_line long, rms_low double, rms_line double")


@query("resample_lines", """
WITH s AS (SELECT vec_id, embedding AS e, len(embedding) * 3 AS n FROM embeddings),
p AS (SELECT vec_id, e, unnest(range(n // 2)) AS i, (len(e) * 3 - 1)::DOUBLE / (n // 2 - 1) AS step FROM s),
q AS (SELECT vec_id, e, i * step AS x, floor(i * step)::BIGINT AS k, len(e) * 3 - 1 AS last_ FROM p)
SELECT vec_id, count(*) AS n, round(sum((e[k // 3 + 1]::DOUBLE * (1 - (x - k)) + e[least(k + 1, last_) // 3 + 1]::DOUBLE * (x - k)) * x), 2) AS moment FROM q GROUP BY vec_id""")  # fmt: skip
def resample_lines(spark, sf_dir):
    """Each vector, every component thrice, as sound at 32 kHz brought to 16 kHz by straight lines."""

    def bring(batches):
        import numpy as np

        for b in batches:
            out = [audio.resample(np.repeat(np.asarray(x, np.float32), 3), 32_000).astype(float) for x in b["embedding"]]
            at = [np.linspace(0, 3 * len(x) - 1, len(y)) for x, y in zip(b["embedding"], out, strict=True)]
            yield pd.DataFrame({"vec_id": b["vec_id"], "n": [len(y) for y in out], "moment": [float((y * x).sum()) for x, y in zip(at, out, strict=True)]})

    got = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(bring, "vec_id long, n long, moment double")
    return got.select("vec_id", "n", F.round("moment", 2).alias("moment"))


@query("energy_to_probability", "SELECT event_id, round(least(1.0, greatest(0.0, (value / 1000 - 0.008) / (0.06 - 0.008)))::DOUBLE, 6) AS prob FROM events")
def energy_to_probability(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(audio.energy_probability(F.col("value") / 1000), 6).alias("prob"))

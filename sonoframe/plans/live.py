"""Queries of live sessions and uploads: chains of operators, and payloads as clients get them.

Events stand for chunks, controls and frames, turns of conversations for what two models heard.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.functions import hotwords as hw
from sonoframe.functions import parsing
from sonoframe.operators import emotion, engine, fusion, messages, session
from sonoframe.params import Params
from sonoframe.plans.registry import query, table
from sonoframe.plans.transcripts import SQL_FUSED, hypotheses, known, token_overlap
from sonoframe.sources import audio as sources


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# -- what clients get

@query("vad_events", """
SELECT event_id, '{"type":"vad_event","event":"segment_detected","id":"' || user_id || '-' || event_id || '","duration":"' || format('{:.1f}', abs(value) / 100) || 's","audio_b64":"' || to_base64(event_type::BLOB) || '"}' AS message FROM events""")  # fmt: skip
def vad_events(spark, sf_dir):
    made = messages.vad_event(F.concat_ws("-", "user_id", "event_id"), F.abs("value") / 100, F.base64(F.col("event_type").cast("binary")))
    return events(spark, sf_dir).select("event_id", made.alias("message"))


@query("response_messages", """
SELECT event_id, '{"type":"response","id":"' || event_id || '","text":"' || event_type || '","model_hotwords":["' || event_type || '"]' || CASE WHEN user_id % 3 = 0 THEN '' ELSE ',"src_lang_detected":"English"' END
  || ',"text_primary":"' || event_type || '","text_secondary":"","fusion_meta":{"selected":"primary_empty"}' || CASE WHEN value > 100 THEN ',"emotion":{"ser_label":"Sad","sec_text":"","sec_label":""}' ELSE '' END || '}' AS message FROM events""")  # fmt: skip
def response_messages(spark, sf_dir):
    debug = {"text_primary": F.col("event_type"), "text_secondary": F.lit(""), "fusion_meta": F.struct(F.lit("primary_empty").alias("selected"))}
    feeling = F.when(F.col("value") > 100, F.struct(F.lit("Sad").alias("ser_label"), F.lit("").alias("sec_text"), F.lit("").alias("sec_label")))
    language = F.when(F.col("user_id") % 3 == 0, "").otherwise("English")
    made = messages.response(F.col("event_id").cast("string"), F.col("event_type"), F.array("event_type"), language, debug, feeling)
    return events(spark, sf_dir).select("event_id", made.alias("message"))


@query("terminator_rows", """
WITH s AS (SELECT user_id, max((event_type = 'error')::INT) AS stopped, max((event_type = 'purchase' AND value > 150)::INT) AS spoke FROM events GROUP BY user_id),
t AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'English' ELSE '' END AS language FROM s WHERE stopped = 1 AND spoke = 0)
SELECT user_id AS session_id, CASE user_id % 3 WHEN 0 THEN '{"type":"final","text":"","language":"' || language || '"}' WHEN 1 THEN '{"type":"final","text":"","language":"' || language || '","task":"tsasr"}'
  ELSE '{"type":"final_emotion","mode":"ser","label":"","text":"","duration_sec":0.0' || CASE WHEN language <> '' THEN ',"language":"' || language || '"' ELSE '' END || '}' END AS message
FROM t WHERE user_id % 3 < 2 OR user_id % 5 <> 0""")  # fmt: skip
def terminator_rows(spark, sf_dir):
    df = events(spark, sf_dir)
    task = F.when(F.col("session_id") % 3 == 0, "asr").when(F.col("session_id") % 3 == 1, "tsasr").otherwise("emotion")
    sessions = df.groupBy(F.col("user_id").alias("session_id")).agg(F.max(F.col("event_type") == "error").alias("stopped"))
    sessions = sessions.withColumns({"task": task, "language": F.when(F.col("session_id") % 2 == 0, "English").otherwise(""), "mode": F.lit("ser"), "streaming": F.col("session_id") % 5 == 0})
    return session.terminators(sessions, df.where("event_type = 'purchase' AND value > 150").select(F.col("user_id").alias("session_id")), "session_id")


@query("emotion_pairs", """
WITH a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS label FROM events WHERE event_id % 3 <> 0),
b AS (SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '' ELSE 'a voice' END AS text, CASE WHEN event_id % 4 = 2 THEN 'Sad' ELSE '' END AS label FROM events WHERE event_id % 5 <> 0)
SELECT event_id, trim(coalesce(a.label, '')) AS ser_label, coalesce(b.text, '') AS sec_text, coalesce(b.label, '') AS sec_label
FROM a FULL JOIN b USING (event_id) WHERE trim(coalesce(a.label, '')) || coalesce(b.text, '') || coalesce(b.label, '') <> ''""")  # fmt: skip
def emotion_pairs(spark, sf_dir):
    df, k = events(spark, sf_dir), F.col("event_id") % 4
    labels = df.where("event_id % 3 <> 0").select("event_id", F.when(k == 0, " ").otherwise(F.col("event_type")).alias("label"))
    summaries = df.where("event_id % 5 <> 0").select("event_id", F.when(k < 2, "").otherwise("a voice").alias("text"), F.when(k == 2, "Sad").otherwise(F.lit(None)).alias("label"))
    return emotion.pair_emotions(labels, summaries, "event_id").select("event_id", "emotion.*")


# -- live controls

@query("control_state", """
WITH c AS (SELECT *, CASE WHEN event_type = 'signup' THEN props END AS words, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'English' ELSE 'Thai' END END AS lang, CASE WHEN event_type = 'purchase' THEN value > 50 END AS feel FROM events)
SELECT event_id, words_as_of, src_lang_as_of, emotion_as_of FROM (SELECT event_id, event_type,
  last_value(words IGNORE NULLS) OVER w AS words_as_of, last_value(lang IGNORE NULLS) OVER w AS src_lang_as_of, last_value(feel IGNORE NULLS) OVER w AS emotion_as_of
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE event_type IN ('click', 'error')""")  # fmt: skip
def control_state(spark, sf_dir):
    """What hotwords, language and emotion switch each frame is under: three kinds of controls change one each."""
    df, kind = events(spark, sf_dir), F.col("event_type")
    controls = df.where(~kind.isin("click", "error")).select(
        "user_id", "ts", F.when(kind == "signup", F.col("props")).alias("words"), F.when(kind == "view", F.when(F.col("event_id") % 2 == 0, "English").otherwise("Thai")).alias("src_lang"), F.when(kind == "purchase", F.col("value") > 50).alias("emotion")
    )
    frames = df.where(kind.isin("click", "error")).select("user_id", "ts", "event_id")
    return session.as_of(frames, controls, "user_id", "ts", ["words", "src_lang", "emotion"]).select("event_id", "words_as_of", "src_lang_as_of", "emotion_as_of")


@query("extract_match", """
WITH r AS (SELECT *, CASE WHEN event_type = 'signup' THEN event_id % 3 END AS asked, event_id % 3 AS answers FROM events),
w AS (SELECT *, last_value(asked IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS waits FROM r)
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, answers ORDER BY ts) AS n FROM w WHERE event_type = 'click' AND answers = waits) WHERE n = 1""")  # fmt: skip
def extract_match(spark, sf_dir):
    """The first answer to each request that was waited for when it came."""
    df = events(spark, sf_dir).withColumn("request_id", F.col("event_id") % 3)
    requests = df.where("event_type = 'signup'").select("user_id", "ts", "request_id")
    return session.answered(requests, df.where("event_type = 'click'").select("user_id", "ts", "request_id", "event_id"), "user_id", "ts").select("event_id")


@query("utterance_ids", """
WITH f AS (SELECT *, value > 60 AS on_, coalesce(lag(value > 60) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM events)
SELECT event_id, CASE WHEN on_ THEN sum((on_ AND NOT was)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END::BIGINT AS utterance FROM f""")  # fmt: skip
def utterance_ids(spark, sf_dir):
    frames = events(spark, sf_dir).withColumn("speaking", F.col("value") > 60)
    return session.utterances(frames, "user_id", ["ts", "event_id"]).select("event_id", "utterance")


@query("single_flight_partials", """
WITH s AS (SELECT user_id, list_sort(list({'at': epoch_us(ts)::DOUBLE, 'took': value * 1e7::DOUBLE})) AS l FROM events GROUP BY user_id),
r AS (SELECT user_id, list_reduce(l, lambda a, x: CASE WHEN x.at >= a.free THEN {'free': greatest(x.at + x.took, x.at + 5e8::DOUBLE), 'sent': list_append(a.sent, x.at)} ELSE a END,
  {'free': -1e18::DOUBLE, 'sent': []::DOUBLE[]}).sent AS sent FROM s)
SELECT user_id, unnest(sent)::BIGINT AS at FROM r""")  # fmt: skip
def single_flight_partials(spark, sf_dir):
    """Of each user's events those that start while no earlier one is in flight, nor 500 seconds after it began."""
    snapshots = events(spark, sf_dir).select("user_id", F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")).cast("double").alias("at"), (F.col("value") * 1e7).alias("took"))
    return session.single_flight(snapshots, "user_id", "at", "took", 5e8).select("user_id", F.col("at").cast("bigint").alias("at"))


@query("hotword_buckets", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '["' || event_type || '","x"]' WHEN 1 THEN '[]' ELSE '[]' END AS stored, CASE event_id % 3 WHEN 0 THEN 2 ELSE 0 END AS n FROM events""")
def hotword_buckets(spark, sf_dir):
    """Stored hotwords of a language: a list, something that isn't one, and nothing; read, and written again."""
    stored = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type", F.lit("x")))).when(F.col("event_id") % 3 == 1, F.col("props"))
    words = hw.read_bucket(stored)
    return events(spark, sf_dir).select("event_id", hw.write_bucket(words).alias("stored"), F.size(words).alias("n"))


# -- frames of sound

@query("vad_probability", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(1.0, greatest(0.0, value / 100 - 0.5))::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE 1.0 END AS prob FROM events")
def vad_probability(spark, sf_dir):
    k = F.col("event_id") % 4
    answer = F.when(k == 0, (F.col("value") / 100 - 0.5).cast("string")).when(k == 1, F.col("event_type")).when(k == 2, F.lit("NaN")).otherwise("7")
    return events(spark, sf_dir).select("event_id", au.probability(answer).alias("prob"))


@query("native_vad_input", "SELECT event_id, trunc(greatest(-1.0, least(1.0, (value - 50) / 100))::DOUBLE * 32767)::INT AS sample FROM events")
def native_vad_input(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", au.native_vad_input((F.col("value") - 50) / 100).alias("sample"))


@query("hop_carry", """
SELECT event_id, (e - n) // 160 AS first_hop, e // 160 - (e - n) // 160 AS n_hops, e % 160 AS carry FROM (
  SELECT event_id, floor(value)::BIGINT AS n, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e FROM events)""")  # fmt: skip
def hop_carry(spark, sf_dir):
    """Each event as a chunk of samples: the hops of 10 ms that it completes."""
    return au.whole_hops(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.floor("value"), Params().hop).select("event_id", "first_hop", "n_hops", "carry")


@query("microphone_chunks", """
SELECT event_id, (128 * i) // 1440 - (128 * (i - 1)) // 1440 AS n_chunks, (128 * i) % 1440 AS carry FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)""")  # fmt: skip
def microphone_chunks(spark, sf_dir):
    """Each event as 128 samples at 48 kHz, brought to chunks of 30 ms."""
    got = au.whole_hops(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.lit(128), 1440)
    return got.select("event_id", F.col("n_hops").alias("n_chunks"), "carry")


@query("whole_utterances", "SELECT user_id, count(*)::INT AS n_frames, sum(length(event_type))::INT AS n_bytes, md5(string_agg(event_type, '' ORDER BY ts, event_id)) AS digest FROM events GROUP BY user_id")
def whole_utterances(spark, sf_dir):
    """All frames of a session as one clip."""
    got = au.joined_pcm(events(spark, sf_dir).withColumn("pcm", F.col("event_type").cast("binary")), ["user_id"], ["ts", "event_id"])
    return got.select("user_id", "n_frames", F.octet_length("pcm").alias("n_bytes"), F.md5("pcm").alias("digest"))


@query("speech_segments_joined", "SELECT user_id, s, md5(string_agg(event_type, '' ORDER BY ts, event_id)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) // 7 AS s FROM events) GROUP BY user_id, s")
def speech_segments_joined(spark, sf_dir):
    """Runs of seven frames of a session, each as one clip."""
    numbered = session.numbered_outputs(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").withColumn("s", F.floor(F.col("ordinal") / 7))
    return au.joined_pcm(numbered.withColumn("pcm", F.col("event_type").cast("binary")), ["user_id", "s"], ["ts", "event_id"]).select("user_id", "s", F.md5("pcm").alias("digest"))


SQL_DECODED = "trunc(greatest(-32768, least(32767, ({0}::FLOAT * 32767::FLOAT)::FLOAT)))"


@query("wav_widths", f"""
WITH v AS (SELECT vec_id, embedding, (2::BIGINT ** (7 + 8 * (vec_id % 4)))::DOUBLE AS full_, vec_id % 8 < 4 AS mono FROM embeddings),
q AS (SELECT vec_id, full_, mono, list_transform(embedding, lambda x: (trunc(x::DOUBLE * (full_ - 1)))::BIGINT) AS l FROM v)
SELECT vec_id, len(l)::BIGINT AS n_samples, list_sum(list_transform(l, lambda k: {SQL_DECODED.format("((k::FLOAT / full_::FLOAT)::FLOAT / (CASE WHEN mono THEN 1 ELSE 2 END)::FLOAT)")}))::BIGINT AS total FROM q""")  # fmt: skip
def wav_widths(spark, sf_dir):
    """Each vector as a WAV file of 8, 16, 24 or 32 bits, with a silent second channel or without, as decoded."""

    def add(batches):
        import numpy as np

        for b in batches:
            samples = (np.frombuffer(x, "<i2") for x in b["pcm"])
            sums = [(len(x), int(x.sum(dtype=np.int64))) for x in samples]
            yield pd.DataFrame({"vec_id": b["vec_id"], "n_samples": [n for n, _ in sums], "total": [t for _, t in sums]})

    made = wide_files(table(spark, sf_dir, "embeddings"))
    return made.select("vec_id", au.decode_wav("content").alias("d")).select("vec_id", "d.pcm").mapInPandas(add, "vec_id long, n_samples long, total long")


def wide_files(vectors: DataFrame) -> DataFrame:
    """(vec_id, content): the WAV files of wav_widths."""
    width, channels = F.pmod("vec_id", F.lit(4)) + 1, F.when(F.pmod("vec_id", F.lit(8)) < 4, 1).otherwise(2)
    full = F.pow(F.lit(2.0), 8 * width - 1) - 1

    def sample(x: Column) -> Column:
        whole = (x.cast("double") * full).cast("long")
        # the lower bytes of four; single bytes are unsigned
        held = little(F.pmod(whole + F.when(width == 1, 128).otherwise(0), F.lit(1 << 32))).substr(F.lit(1), (2 * width).cast("int"))
        return F.when(F.abs(whole) > full, F.raise_error(F.lit("a component is over 1"))).otherwise(held)

    silent = F.when(channels == 1, "").when(width == 1, "80").otherwise(F.repeat(F.lit("00"), width.cast("int")))
    body = F.array_join(F.transform("embedding", lambda x: F.concat(sample(x), silent)), "")
    size, short = F.length(body) / 2, lambda n: little(n).substr(1, 4)
    head = F.concat(F.lit(b"WAVEfmt ".hex()), little(F.lit(16)), short(F.lit(1)), short(channels), little(F.lit(au.RATE)), little(au.RATE * width * channels), short(width * channels), short(8 * width), F.lit(b"data".hex()))
    return vectors.select("vec_id", F.unhex(F.concat(F.lit(b"RIFF".hex()), little((36 + size).cast("long")), head, little(size.cast("long")), body)).alias("content"))


def little(number: Column) -> Column:
    """Four bytes in hex, the low one first."""
    digits = F.lpad(F.hex(number.cast("long")), 8, "0")
    return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])


# -- clips that come whole

def silent_clips(spark: SparkSession, sf_dir: str, n: Column) -> DataFrame:
    """(event_id, content): a silent clip of ``n`` samples, or as many bytes that aren't one where ``n`` is negative."""
    empty, size = au.wav([]).hex(), 2 * n.cast("long")
    clip = F.unhex(F.concat(F.lit(empty[:8]), little(36 + size), F.lit(empty[16:80]), little(size), F.repeat(F.lit("00"), size.cast("int"))))
    return events(spark, sf_dir).select("event_id", F.when(n >= 0, clip).otherwise(F.repeat(F.lit("x"), -n.cast("int")).cast("binary")).alias("content"))


@query("upload_codes", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'decode_failed' WHEN 1 THEN 'empty_audio' WHEN 2 THEN 'too_large' WHEN 3 THEN 'empty' END AS error,
  CASE WHEN event_id % 6 = 4 THEN 0.01::DOUBLE WHEN event_id % 6 = 5 THEN 0.0125::DOUBLE END AS seconds FROM events""")  # fmt: skip
def upload_codes(spark, sf_dir):
    """Uploads that aren't WAV, hold no sample, are too large or empty, and clips of 160 and of 240 samples, of which 200 are kept."""
    k = F.col("event_id") % 6
    files = silent_clips(spark, sf_dir, F.when(k == 0, -9).when(k == 1, 0).when(k == 2, 900).when(k == 3, 0).when(k == 4, 160).otherwise(240))
    files = files.select(F.col("event_id").alias("path"), F.when(k == 3, F.lit(b"")).otherwise(F.col("content")).alias("content"))
    got = sources.validate_uploads(files.withColumn("length", F.octet_length("content")), Params().override({"upload_max_bytes": 1000, "upload_max_sec": 0.0125}))
    return got.select(F.col("path").alias("event_id"), "error", F.when(F.col("error").isNull(), F.col("seconds")).alias("seconds"))


@query("enrollment_codes", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'unsupported_format' WHEN 2 THEN 'decode_failed' WHEN 3 THEN 'empty' WHEN 4 THEN 'too_short' END AS error,
  CASE WHEN event_id % 6 = 5 THEN 0.0125::DOUBLE END AS seconds FROM events""")  # fmt: skip
def enrollment_codes(spark, sf_dir):
    k = F.col("event_id") % 6
    clips = silent_clips(spark, sf_dir, F.when(k == 2, -9).when(k == 3, 0).when(k == 4, 80).otherwise(200))
    rows = clips.select(F.col("event_id").alias("session_id"), F.when(k == 0, "").otherwise(F.base64("content")).alias("audio_b64"), F.when(k == 1, "mp3").when(k == 5, " WAV ").alias("format"))
    got = sources.enrollments(rows, Params().override({"enrollment_min_sec": 0.01, "enrollment_max_sec": 0.05}))
    return got.select(F.col("session_id").alias("event_id"), "error", "seconds")


def heard(prefix: str, k) -> engine.Model:
    """A model whose answer follows from a clip's key: nothing for some, a text for the others."""

    def answer(clips: DataFrame) -> DataFrame:
        key = "path" if "path" in clips.columns else "segment_id"
        number = F.col(key).cast("long")
        return clips.select(key, F.when(k(number), "").otherwise(F.concat(F.lit(prefix), number % 5)).alias("text"), F.when(number % 2 == 0, "Thai").alias("detected_language"))

    return answer


@query("transcribed_uploads", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 400 ELSE 200 END AS status, CASE WHEN event_id % 6 > 0 THEN '{"type":"final","text":"' || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'said ' || event_id % 5 END
  || '","language":"' || CASE WHEN event_id % 2 = 0 THEN 'Thai' ELSE 'English' END || '","duration_sec":0.01}' END AS message FROM events""")  # fmt: skip
def transcribed_uploads(spark, sf_dir):
    """From file to message: decoding, capping, two models, fusion. A clip in which the second model hears nothing is silent."""
    files = silent_clips(spark, sf_dir, F.when(F.col("event_id") % 6 == 0, -9).otherwise(160)).select(F.col("event_id").alias("path"), F.octet_length("content").alias("length"), "content")
    made = engine.transcribe_uploads(files, heard("said ", lambda n: n % 7 == 0), heard("said ", lambda n: n % 4 == 0), language=F.lit("English"), similarity=token_overlap())
    return made.select(F.col("path").alias("event_id"), "status", "message")


@query("emotion_uploads", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 400 WHEN event_id % 5 = 0 THEN 502 ELSE 200 END AS status, CASE WHEN event_id % 6 > 0 AND event_id % 5 > 0 THEN
  '{"type":"final_emotion","mode":"sec","label":"Sad","text":"a sad voice","raw_text":"{a sad voice}","language":"English","duration_sec":0.01}' END AS message FROM events""")  # fmt: skip
def emotion_uploads(spark, sf_dir):
    files = silent_clips(spark, sf_dir, F.when(F.col("event_id") % 6 == 0, -9).otherwise(160)).select(F.col("event_id").alias("path"), F.octet_length("content").alias("length"), "content")
    model = lambda clips: clips.where("path % 5 > 0").select("path", F.lit("Sad").alias("label"), F.lit("a sad voice").alias("text"), F.lit("{a sad voice}").alias("raw_text"))
    return engine.emotion_of_uploads(files, model, "sec", language=F.lit("English")).select(F.col("path").alias("event_id"), "status", "message")


@query("target_uploads", """
WITH e AS (SELECT event_id, event_id % 6 = 0 AS unreadable, CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'decode_failed' WHEN 2 THEN 'too_short' END AS refused, event_id % 7 = 0 AS failed FROM events)
SELECT event_id, CASE WHEN unreadable OR refused IS NOT NULL THEN 400 WHEN failed THEN 502 ELSE 200 END AS status,
  CASE WHEN unreadable THEN NULL WHEN refused IS NOT NULL THEN '{"code":"enrollment_' || refused || '"}' WHEN failed THEN NULL
  ELSE '{"type":"final","task":"tsasr","text":"mine ' || event_id % 5 || '","language":"' || CASE WHEN event_id % 2 = 0 THEN 'Thai' ELSE 'English' END || '","duration_sec":0.01}' END AS message FROM e""")  # fmt: skip
def target_uploads(spark, sf_dir):
    """Without its audio, the message of each upload: files that can't be read first, then enrollments that can't be used, by their code, then models that fail."""
    files = silent_clips(spark, sf_dir, F.when(F.col("event_id") % 6 == 0, -9).otherwise(160)).select(F.col("event_id").alias("path"), F.octet_length("content").alias("length"), "content")
    k = F.col("event_id") % 5
    clips = silent_clips(spark, sf_dir, F.when(k == 1, -9).when(k == 2, 80).otherwise(200))
    enrolled = clips.where(k > 0).select(F.col("event_id").alias("path"), F.base64("content").alias("audio_b64"))
    params = Params().override({"enrollment_min_sec": 0.01, "enrollment_max_sec": 0.05})
    said = heard("mine ", lambda n: F.lit(False))
    made = engine.target_uploads(files, lambda c: said(c.where("path % 7 > 0")), enrolled, params, language=F.lit("English"))
    return made.select(F.col("path").alias("event_id"), "status", F.regexp_replace("message", ',"audio_b64":"[^"]*"', "").alias("message"))


@query("task_messages", """
WITH s AS (SELECT event_id, user_id, event_id % 4 = 0 AS silent FROM events WHERE event_id % 3 = 0),
f AS (SELECT user_id::VARCHAR AS session_id, event_id AS place, '{"type":"final","text":"said ' || event_id % 5 || '","language":"' || CASE WHEN event_id % 2 = 0 THEN 'Thai' ELSE 'English' END || '"}' AS message FROM s WHERE NOT silent),
u AS (SELECT DISTINCT user_id::VARCHAR AS session_id FROM events)
SELECT * FROM f UNION ALL SELECT session_id, NULL, '{"type":"final","text":"","language":"English"}' FROM u WHERE session_id NOT IN (SELECT session_id FROM f)""")  # fmt: skip
def task_messages(spark, sf_dir):
    """The messages of a transcription task over sessions of segments, with an end for sessions that had none."""
    df = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("place"), F.col("event_id").alias("segment_id"), F.lit(b"").alias("pcm"), F.lit("English").alias("language"))
    sessions = df.select("session_id", "language").distinct().withColumn("stopped", F.lit(True))
    task = engine.Transcription(heard("said ", lambda n: F.lit(False)), heard("said ", lambda n: n % 4 == 0), similarity=token_overlap())
    return engine.run(task, df.where("place % 3 = 0"), sessions=sessions)


# -- two hypotheses

@query("fused_messages", f"""{SQL_FUSED}, said AS (SELECT *, CASE WHEN p_there AND NOT s_there THEN pt WHEN s_there AND NOT p_there THEN st WHEN branch = 1 THEN '' WHEN branch IN (3, 5, 6) THEN pt ELSE st END AS final FROM chosen)
SELECT segment_id, final AS text, CASE WHEN p_there AND NOT s_there THEN 'primary' WHEN s_there AND NOT p_there THEN 'secondary' ELSE 'both' END AS sides FROM said WHERE final <> ''""")  # fmt: skip
def fused_messages(spark, sf_dir):
    """Each segment's final text, with a likeness that SQL can say."""
    df = fusion.final_text(fusion.pair_hypotheses(*hypotheses(spark, sf_dir)), hotwords=known(), similarity=token_overlap()).where(F.col("final") != "")
    sides = F.when(F.col("primary_there") & F.col("secondary_there"), "both").when(F.col("primary_there"), "primary").otherwise("secondary")
    return df.select("segment_id", F.col("final").alias("text"), sides.alias("sides"))


@query("partial_choice", f"""{SQL_FUSED}, said AS (SELECT *, CASE WHEN s_there AND NOT p_there THEN st WHEN branch IN (3, 5, 6) THEN pt ELSE st END AS final FROM chosen WHERE trim(st) <> '')
SELECT segment_id, final AS text FROM said WHERE trim(final) <> ''""")  # fmt: skip
def partial_choice(spark, sf_dir):
    return fusion.partial_text(fusion.pair_hypotheses(*hypotheses(spark, sf_dir)), hotwords=known(), similarity=token_overlap()).select("segment_id", F.col("final").alias("text"))


@query("primary_partials", f"""{SQL_FUSED} SELECT segment_id, '{{"type":"partial_transcript","utterance_id":"' || segment_id || '","text":' || length(regexp_replace(pt, '^\\s+|\\s+$', '', 'g')) || ',"seq":1}}' AS message
FROM chosen WHERE regexp_replace(pt, '^\\s+|\\s+$', '', 'g') <> '' AND regexp_replace(st, '^\\s+|\\s+$', '', 'g') <> ''""")  # fmt: skip
def primary_partials(spark, sf_dir):
    """Partials that show the primary text once the secondary model hears speech; the length stands for the text here."""
    shown = fusion.primary_partial(fusion.pair_hypotheses(*hypotheses(spark, sf_dir)))
    return shown.select("segment_id", messages.partial_transcript(F.col("segment_id"), F.char_length("final"), F.lit(1)).alias("message"))


# -- fields

@query("parse_csv", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(role || ' , ,' || turn || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS words FROM conversations")
def parse_csv(spark, sf_dir):
    raw = F.concat(F.col("role"), F.lit(" , ,"), F.col("turn").cast("string"), F.lit(","))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(hw.parse_csv(raw), "|").alias("words"))


@query("model_endpoints", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'http://own:' ELSE 'http://shared:' END || event_id || '/v1/chat/completions' AS endpoint FROM events""")  # fmt: skip
def model_endpoints(spark, sf_dir):
    """A task's own server or the shared one, with the path that requests go to."""
    own = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("http://own:"), "event_id", F.when(F.col("event_id") % 4 == 0, "/v1/").otherwise("/v1/chat/completions"))).otherwise("")
    made = messages.extract_endpoint(messages.endpoint(own, F.concat(F.lit("http://shared:"), "event_id", F.lit("/v1"))))
    return events(spark, sf_dir).select("event_id", made.alias("endpoint"))


@query("content_text", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || chr(10) || turn ELSE role END AS text FROM conversations")
def content_text(spark, sf_dir):
    part = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    listed = F.to_json(F.array(part(F.col("role")), part(F.lit("")), part(F.col("turn").cast("string"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.content_text(F.when(F.col("turn") % 2 == 0, listed).otherwise(F.col("role"))).alias("text"))


@query("bare_transcripts", "SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'the language ' || role || ' here' ELSE role || ' said' END AS text FROM conversations")
def bare_transcripts(spark, sf_dir):
    """Language tags in front go, in three forms; one within a text stays."""
    said, k = F.concat("role", F.lit(" said")), F.col("turn") % 4
    raw = F.when(k == 0, F.concat(F.lit(" language English<asr_text> "), said)).when(k == 1, F.concat(F.lit("Language Thai: "), said)).when(k == 2, F.concat(F.lit("language 中文 "), said)).otherwise(F.concat(F.lit("the language "), "role", F.lit(" here ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.bare_transcript(raw).alias("text"))


@query("strict_language", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Thai' ELSE 'N/A' END AS language, CASE WHEN doc_id % 3 = 0 THEN 'Thai' WHEN doc_id % 3 = 1 THEN 'thai' ELSE lang END AS detected FROM documents")
def strict_language(spark, sf_dir):
    """Names as they must be written, and a detected language that falls back to the requested one."""
    k = F.col("doc_id") % 3
    name = F.when(k == 0, "Thai").when(k == 1, "thai").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", parsing.strict_language(name).alias("language"), fusion.detected_or(name, F.col("lang")).alias("detected"))


@query("target_request", """
SELECT conv_id, turn, 'text:Given the speaker''s voice:|audio:E|' || CASE WHEN turn % 2 = 0 THEN 'text:' || chr(10) || 'Speaker traits: ' || role || '.|' ELSE '' END || CASE WHEN turn % 3 = 0 THEN 'text:' || chr(10) || 'Hotwords: ' || role || ',x.|' ELSE '' END
  || 'text:' || chr(10) || 'Transcribe what this speaker says in the following audio:|audio:M' AS parts FROM conversations""")  # fmt: skip
def target_request(spark, sf_dir):
    """The parts of a request for one speaker's words, in order."""
    words = F.when(F.col("turn") % 3 == 0, F.array("role", F.lit("x")))
    content = messages.target_content(F.lit("E"), F.lit("M"), words, F.when(F.col("turn") % 2 == 0, F.col("role")))
    shown = F.transform(content, lambda p: F.when(p["type"] == "text", F.concat(F.lit("text:"), p["text"])).otherwise(F.concat(F.lit("audio:"), p["input_audio"]["data"])))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(shown, "|").alias("parts"))

"""Streams over several micro-batches, rounding, quantiles, settings, and the seam for tasks."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.functions import parsing
from sonoframe.operators import engine, messages, metrics, session, vad
from sonoframe.sources import audio as sources
from sonoframe.streaming import vad_stream

RULES = vad.Rules(0.65, 0.0, 2, 3, 1, 2)
SCHEMA = "session_id string, seq long, kind string, prob double, control string, payload binary"


def streamed(spark, tmp_path, batches, build, name):
    """What a stream puts out when each list of rows arrives in a micro-batch of its own."""
    folder = tmp_path / "in"
    for rows in batches:
        full = [tuple(r) + (None,) * (6 - len(r)) for r in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would keep the query busy
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).collect()


def frames(start, probs):
    return [("s", start + i, "frame", p) for i, p in enumerate(probs)]


SPOKEN = [0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0]


def test_frames_before_start_and_after_stop_are_ignored(spark, tmp_path):
    batches = [frames(0, SPOKEN), [("s", 10, "start", None), *frames(11, SPOKEN)], [("s", 20, "start", None), *frames(21, SPOKEN), ("s", 30, "stop", None)], frames(31, SPOKEN)]
    got = streamed(spark, tmp_path, batches, lambda s: vad_stream.segment_stream(s, RULES, need_start=True), "gated")
    assert [(r["seg_seq"], r["is_flush"]) for r in sorted(got, key=lambda r: r["seg_seq"])] == [(0, False), (1, False)]


def test_a_stop_closes_the_open_segment_once(spark, tmp_path):
    batches = [frames(0, [0.0, 1.0, 1.0]), frames(3, [1.0]), [("s", 4, "stop", None)], [("s", 5, "stop", None), *frames(6, SPOKEN)]]
    got = streamed(spark, tmp_path, batches, lambda s: vad_stream.segment_stream(s, RULES), "stopped")
    assert [(r["seg_seq"], r["start_frame"], r["end_frame"], r["is_flush"]) for r in got] == [(0, 1, 3, True)]


def test_segments_carry_the_controls_that_hold_when_they_close(spark, tmp_path):
    batches = [
        [("s", 0, "start", None, json.dumps({"hotwords": ["a"], "language": "English"})), *frames(1, SPOKEN)],
        [("s", 9, "control", None, json.dumps({"hotwords": ["b", "c"]})), ("s", 10, "control", None, "not json"), *frames(11, SPOKEN)],
    ]
    got = streamed(spark, tmp_path, batches, lambda s: vad_stream.live_stream(s, RULES), "controlled")
    assert [(r["utterance"], list(r["hotwords"]), r["language"]) for r in sorted(got, key=lambda r: r["seg_seq"])] == [(1, ["a"], "English"), (2, ["b", "c"], "English")]


def test_partials_grow_and_keep_their_distance(spark, tmp_path):
    batches = [frames(0, [0.0, 1.0, 1.0]), frames(3, [1.0]), frames(4, [1.0, 1.0, 1.0]), frames(7, [0.0, 0.0, 0.0])]
    got = streamed(spark, tmp_path, batches, lambda s: vad_stream.live_stream(s, RULES, partial_frames=3), "growing")
    assert [(r["kind"], r["start_frame"], r["end_frame"], r["utterance"]) for r in sorted(got, key=lambda r: r["end_frame"])] == [("partial", 1, 2, 1), ("partial", 1, 6, 1), ("final", 1, 7, 1)]


def test_whole_utterances_keep_their_sound(spark, tmp_path):
    rows = [("s", i, "frame", None, None, bytes([i]) * 2) for i in range(6)]
    batches = [[("s", -1, "start", None), *rows[:3][::-1]], [*rows[3:], ("s", 9, "stop", None)], [("s", 10, "frame", None, None, b"zz")]]
    got = streamed(spark, tmp_path, batches, lambda s: vad_stream.utterance_stream(s, most_seconds=5 / au.RATE), "whole")
    assert [(r["n_frames"], bytes(r["pcm"])) for r in got] == [(6, b"".join(bytes([i]) * 2 for i in range(1, 6)))]


def test_decimated_chunks_of_several_batches(spark, tmp_path):
    sound = (np.sin(np.arange(3000) / 9) * 0.5).astype(np.float32)
    chunks = [au.to_pcm16(x) for x in np.array_split(sound, 7)]
    rows = [("s", i, "frame", None, None, c) for i, c in enumerate(chunks)]
    got = streamed(spark, tmp_path, [rows[:2], rows[2:5], rows[5:]], vad_stream.decimate_stream, "decimated")
    whole = au.to_pcm16(au.Decimator().feed(np.concatenate([au.pcm16(c) for c in chunks])))
    assert b"".join(bytes(r["pcm"]) for r in sorted(got, key=lambda r: r["seq"])) == whole


def test_durations_round_as_exact_values_do(spark):
    values = sorted({n / 100 for n in range(0, 700)} | {n / 16_000 for n in range(0, 40_000, 37)} | {n / 20 for n in range(3000)})
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", messages.one_decimal(F.col("v")).alias("s")).collect()
    assert all(r["s"] == f"{r['v']:.1f}" for r in got)


def test_quantiles_of_groups_that_span_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.integers(0, 50 + 400 * i)) if rng.random() > 0.1 else None) for i, g in enumerate(("a", "b", None)) for _ in range(400)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: r for r in metrics.quantiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        v = [x for k, x in rows if k == g and x is not None]
        assert [got[g][c] for c in ("p50", "p90", "p100")] == pytest.approx(np.quantile(v, [0.5, 0.9, 1.0]).tolist())


def test_settings_come_from_the_named_file(spark, tmp_path):
    (tmp_path / "settings.json.bak").write_text('{"queue_size": 3}')
    assert sources.read_settings(spark, str(tmp_path / "settings.json")).queue_size == 40
    (tmp_path / "settings.json").write_text('{"queue_size": 5}')
    assert sources.read_settings(spark, str(tmp_path / "settings.json")).queue_size == 5


def test_stereo_wav_of_every_width():
    x = np.array([0.5, -0.25, 0.125], np.float32)
    for width in (1, 2, 3, 4):
        top = 2 ** (8 * width - 1)
        whole = [int(v * top) + (128 if width == 1 else 0) for v in x]
        body = b"".join(v.to_bytes(width, "little", signed=width > 1) * 2 for v in whole)
        head = np.array([1 | 2 << 16], "<u4").tobytes() + np.array([16_000, 32_000 * width], "<u4").tobytes() + np.array([2 * width, 8 * width], "<u2").tobytes()
        data = b"RIFF" + (36 + len(body)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + head + b"data" + len(body).to_bytes(4, "little") + body
        np.testing.assert_allclose(au.read_wav(data), x, atol=1e-6)


def test_a_task_without_parts_puts_out_nothing(spark):
    segments = spark.createDataFrame([("s", 1, "g", bytearray(b""), "")], "session_id string, place long, segment_id string, pcm binary, language string")
    sessions = spark.createDataFrame([("s", True, "")], "session_id string, stopped boolean, language string")
    assert engine.run(engine.Task(), segments, snapshots=segments, sessions=sessions).count() == 0


def test_emotion_and_target_tasks(spark):
    segments = spark.createDataFrame([("s", 1, "g", bytearray(4), "Thai"), ("t", 1, "h", bytearray(au.to_pcm16(au.tone(1.0) * 8)), "")], "session_id string, place long, segment_id string, pcm binary, language string")
    sessions = spark.createDataFrame([("s", True, ""), ("t", True, ""), ("u", True, "Thai"), ("v", False, "")], "session_id string, stopped boolean, language string")
    label = lambda clips: clips.where("session_id = 's'").select("segment_id", F.lit("Sad").alias("label"), F.lit("Sad").alias("text"), F.lit("Sad").alias("raw_text"))
    got = {r["session_id"]: json.loads(r["message"]) for r in engine.run(engine.Emotion(label), segments, sessions=sessions).collect()}
    assert got["s"] == {"type": "final_emotion", "mode": "ser", "label": "Sad", "text": "Sad", "language": "Thai", "duration_sec": 0.0}
    assert got["u"] == {"type": "final_emotion", "mode": "ser", "label": "", "text": "", "duration_sec": 0.0, "language": "Thai"} and set(got) == {"s", "t", "u"}
    assert engine.run(engine.Emotion(label, streaming=True), segments, sessions=sessions).count() == 1
    enrolled = spark.createDataFrame([("t", bytearray(b""))], "session_id string, pcm binary")
    said = lambda clips: clips.select("segment_id", F.lit(" mine ").alias("text"), F.lit(None).cast("string").alias("detected_language"))
    got = {r["session_id"]: json.loads(r["message"]) for r in engine.run(engine.TargetTranscription(said, enrolled), segments, sessions=sessions).collect()}
    assert got["t"]["task"] == "tsasr" and got["t"]["text"] == "mine" and got["t"]["id"].endswith("-1")
    assert got["s"] == {"type": "final", "text": "", "language": "", "task": "tsasr"} and set(got) == {"s", "t", "u"}


def test_answers_that_are_parsed_by_their_labels(spark):
    cases = [
        ("Language: English\nHotwords: a, b\nTranscription: hello\nthere", "hello\nthere", ["a", "b"], "English"),
        ("Transcription: hello\nthere\nHotwords: a；b\nLanguage: n/a", "hello\nthere", ["a", "b"], None),
        ("LANGUAGE : thai\\nTRANSCRIPTION : x", "x", [], "thai"),
        ("hotwords: none\nsome text", "hotwords: none\nsome text", ["none\nsome text"], None),
        ("say transcription: no\nhotwords: z", "say transcription: no\nhotwords: z", ["z"], None),
        ("language English<asr_text> hello", "hello", [], None),
        ("Hotwords:\nTranscription: foo", "foo", ["Transcription: foo"], None),
        ("", "", [], None),
        (None, "", [], None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = {r["i"]: r["r"] for r in df.select("i", parsing.parse_transcript(F.col("raw")).alias("r")).collect()}
    for i, (_, said, words, language) in enumerate(cases):
        assert (got[i]["transcription"], got[i]["reported_hotwords"], got[i]["detected_language"]) == (said, words, language), cases[i]


def test_only_awaited_answers_count(spark):
    requests = spark.createDataFrame([("s", 1, "a"), ("s", 5, "b")], "session string, at int, request_id string")
    answers = spark.createDataFrame([("s", 2, "b", 0), ("s", 3, "a", 1), ("s", 4, "a", 2), ("s", 6, "a", 3), ("s", 7, "b", 4)], "session string, at int, request_id string, n int")
    assert sorted(r["n"] for r in session.answered(requests, answers, "session", "at").collect()) == [1, 4]


def test_probabilities_of_odd_answers(spark):
    rows = [("0.5", 0.5), ("-1", 0.0), ("2", 1.0), ("NaN", 0.0), ("x", 0.0), (None, 0.0)]
    got = spark.createDataFrame(rows, "v string, want double").select(au.probability(F.col("v")).alias("p"), "want").collect()
    assert all(r["p"] == r["want"] and not math.isnan(r["p"]) for r in got)

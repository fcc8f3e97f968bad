"""Audio, text, fusion and stream semantics on small fixtures."""

from __future__ import annotations

import base64
import difflib
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.functions import hotwords as hw
from sonoframe.functions import parsing, text
from sonoframe.operators import fusion, vad
from sonoframe.sources import audio as sources
from sonoframe.streaming import vad_stream

QUALITY = [
    ("", "", 0.0, 1.0, 1.0, 1.0),
    ("hello", "hello", 0.65, 0.0, 1.0, 0.0),
    ("hello world", "hello world", 0.7, 0.0, 0.5, 0.0),
    ("a a b", "a a b", 0.4167, 0.3333, 0.6667, 0.0),
    ("um hello，world！", "hello,world!", 0.7, 0.0, 0.5, 0.0),
    ("um um ok", "ok", 0.65, 0.0, 1.0, 0.0),
    ("~~", "", 0.0, 1.0, 1.0, 1.0),
    ("你好世界", "你好世界", 0.65, 0.0, 1.0, 0.0),
    ("Ｈｅｌｌｏ　World", "hello world", 0.7, 0.0, 0.5, 0.0),
    ("@@@ ok", "@@@ ok", 0.45, 0.0, 0.5, 0.5),
]


def test_normal_form_and_quality(spark):
    rows = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUALITY)], "i int, t string")
    got = rows.withColumn("n", text.normalize("t")).withColumn("q", text.quality(F.col("n"), hw.empty(), 0.12)).select("i", "n", "q.*").orderBy("i").collect()
    assert [(r["n"], *[r[c] for c in r.asDict() if c not in ("i", "n")][:4]) for r in got] == [q[1:] for q in QUALITY]


DECISIONS = [
    ("hello world", "", [], "silence", ""),
    ("", "hello world", [], "secondary_only", "hello world"),
    ("call alpha now", "call alfa now", ["Alpha"], "primary_hotword_hit", "call alpha now"),
    ("go go go go", "please go home", [], "secondary_qwen_fallback", "please go home"),
    ("abcdef ghij", "zzzz yyyy xxxx", [], "secondary_qwen_fallback", "zzzz yyyy xxxx"),
    ("hello world", "hello world", [], "primary_agreement", "hello world"),
    ("turn on the big light", "turn turn on light", [], "primary_hotword_advantage", "turn on the big light"),
    ("turn light on", "turn on the big light", [], "secondary_qwen_fallback", "turn on the big light"),
]


def test_each_branch_of_the_decision(spark):
    rows = [(i, *d[:3]) for i, d in enumerate(DECISIONS)]
    base = spark.createDataFrame(rows, "segment_id int, p string, s string, words array<string>")
    one = base.select("segment_id", F.col("p").alias("text"), F.col("words").alias("reported"))
    two = base.select("segment_id", F.col("s").alias("text"), hw.empty().alias("reported"))
    pairs = fusion.pair_hypotheses(one, two).join(base.select("segment_id", "words"), "segment_id")
    got = fusion.decide(pairs, hotwords=F.col("words")).select("segment_id", "fused.*").orderBy("segment_id").collect()
    assert [(r["selected"], r["text"]) for r in got] == [d[3:] for d in DECISIONS]


def test_similarity_is_that_of_longest_matching_blocks(spark):
    pairs = [("abc", "abd"), ("", "a"), ("turn on the big light", "turn turn on light"), ("你好", "你好吗"), ("aaaa", "aa")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.sequence_ratio("a", "b").alias("r")).collect()
    assert all(abs(r["r"] - (difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0.0)) < 1e-9 for r in got)
    assert unicodedata.normalize("NFKC", "Ｈ") == "H"


EMOTIONS = [("Happy", "Happy"), ("Sad.", "Sad"), ("ANGRY", "Angry"), ("Other/Complex", "Other/Complex"), ('```json\n{"label": "angry"}\n```', "Angry"), ("???", ""), (None, "")]


def test_emotion_labels(spark):
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(EMOTIONS)], "i int, raw string").select("i", parsing.parse_emotion(F.col("raw"), F.lit("ser")).alias("e")).orderBy("i").collect()
    assert [(r["e"]["label"] or "") for r in got] == [e for _, e in EMOTIONS]


def test_languages(spark):
    rows = spark.createDataFrame([("zh",), ("EN",), ("English",), ("",), ("xx",), (None,)], "c string")
    assert [r[0] for r in rows.select(parsing.map_language(F.col("c"))).collect()] == ["Chinese", "English", "English", "N/A", "N/A", "N/A"]


@pytest.mark.parametrize("rate", [8_000, 16_000, 44_100, 48_000])
def test_wav_of_any_rate_comes_back_at_16_khz(rate):
    x = 0.6 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    got = au.read_wav(au.wav(x, rate))
    assert abs(len(got) - 16_000) <= 1
    assert abs(np.sqrt(np.mean(got**2)) - 0.6 / np.sqrt(2)) < 0.02


def test_chunks_leave_no_trace_in_decimation():
    x = np.random.default_rng(1).normal(size=9_600) * 0.1
    whole = au.Decimator().feed(x)
    line = au.Decimator()
    parts = np.concatenate([line.feed(x[i : i + 701]) for i in range(0, len(x), 701)])
    assert np.allclose(whole[: len(parts)], parts) and len(whole) - len(parts) <= 1


def test_uploads_that_cannot_be_read(spark):
    rows = [("a", 0, b""), ("b", 9, b"not a wav"), ("c", 44 + 32_000, au.wav(np.zeros(16_000)))]
    files = spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in rows], "path string, length long, content binary")
    got = {r["path"]: r["error"] for r in sources.validate_uploads(files).collect()}
    assert got["a"] == "empty" and got["b"] == "decode_failed" and not got["c"]


def test_enrollments(spark):
    clip = lambda s: base64.b64encode(au.wav(np.full(int(16_000 * s), 0.1))).decode()
    rows = [("ok", clip(2), "wav"), ("short", clip(0.3), "wav"), ("long", clip(8), "wav"), ("none", "", "wav"), ("bad", "!!!not-base64!!!", "wav"), ("mp3", clip(2), "mp3")]
    got = {r["session_id"]: r for r in sources.enrollments(spark.createDataFrame(rows, "session_id string, audio_b64 string, format string")).collect()}
    assert not got["ok"]["error"] and abs(got["ok"]["seconds"] - 2) < 0.01
    assert abs(got["long"]["seconds"] - 5) < 0.01
    assert [got[k]["error"] for k in ("short", "none", "bad", "mp3")] == ["too_short", "missing", "decode_failed", "unsupported_format"]


def frames_of(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(5):
        speaking = np.repeat(rng.random(12) > 0.5, 40)
        rows += [(f"s{s}", i, "frame", float(np.clip(v * 0.8 + rng.normal() * 0.1, 0, 1))) for i, v in enumerate(speaking)]
        rows.append((f"s{s}", len(speaking), "stop", None))
    return rows


def test_streamed_segments_are_those_of_the_whole_table(spark, tmp_path):
    rules = vad.Rules(0.65, 0.35, 10, 20, 4, 16)
    schema = "session_id string, seq long, kind string, prob double"
    rows = frames_of(spark)
    folder = tmp_path / "in"
    for k in range(0, len(rows), 400):
        spark.createDataFrame(rows[k : k + 400], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would keep the query busy
    query = vad_stream.segment_stream(stream, rules).writeStream.format("memory").queryName("live_segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.table("live_segments").collect())
    whole = vad.segments(spark.createDataFrame(rows, schema).where("kind = 'frame'"), rules, order=["seq"])
    assert got == sorted(tuple(r) for r in whole.collect()) and got

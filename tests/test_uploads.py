"""Upload chains over tables that grow with the clips, and the clips that queries make for them."""

import base64
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.operators import engine
from sonoframe.params import Params
from sonoframe.plans import live, sound


def made(spark, n, samples):
    """(path, length, content) of clips that Python makes."""

    def make(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["id"], "content": [au.wav(np.zeros(samples, np.float32)) if i % 5 else b"no sound" for i in b["id"].tolist()]})

    return spark.range(n).mapInPandas(make, "path long, content binary").select("path", F.octet_length("content").alias("length"), "content")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_target_uploads_broadcast_no_clips(spark):
    files = made(spark, 40, 160)
    enrolled = made(spark, 40, 200).where("path % 2 = 0").select(F.col("path") + 1, F.base64("content").alias("audio_b64")).toDF("path", "audio_b64")
    params = Params().override({"enrollment_min_sec": 0.01, "enrollment_max_sec": 0.05})
    seen = []

    def model(clips):
        seen.append(clips.columns)
        return clips.where("path % 7 > 0 AND octet_length(enrollment) = 400").select("path", F.lit(" mine ").alias("text"), F.lit(None).cast("string").alias("detected_language"))

    got = engine.target_uploads(files, model, enrolled, params, language="Thai")
    rows = {r["path"]: (r["status"], r["message"]) for r in got.collect()}
    assert "Broadcast" not in plan(got)
    assert len(seen) == 1 and "refused" not in seen[0] and "sent" not in seen[0]
    for k in range(40):
        usable = k % 2 == 1 and (k - 1) % 5
        code = 400 if k % 5 == 0 or not usable else 502 if k % 7 == 0 else 200
        assert rows[k][0] == code
        if k % 5 and not usable:
            assert rows[k][1] == ('{"code":"enrollment_decode_failed"}' if k % 2 else '{"code":"enrollment_missing"}')
        elif code == 200:
            assert '"text":"mine","language":"Thai"' in rows[k][1] and base64.b64encode(au.wav(np.zeros(160))).decode()[:76] in rows[k][1]
        else:
            assert rows[k][1] is None


@pytest.mark.parametrize("which", ["transcribe", "emotion"])
def test_uploads_broadcast_no_clips(spark, which):
    files = made(spark, 20, 160)
    if which == "transcribe":
        said = lambda clips: clips.select("path", F.lit("a").alias("text"), F.lit("").alias("detected_language"))
        got = engine.transcribe_uploads(files, said, said, similarity=F.lit(1.0))
    else:
        got = engine.emotion_of_uploads(files, lambda c: c.select("path", F.lit("Sad").alias("label"), F.lit("").alias("text"), F.lit("").alias("raw_text")))
    assert sorted(got.groupBy("status").count().collect()) == [(200, 16), (400, 4)]
    assert "Broadcast" not in plan(got)


def test_silent_clips_are_made_without_python(spark, sf):
    got = live.silent_clips(spark, sf, F.when(F.col("event_id") % 3 == 0, -9).otherwise(F.col("event_id") % 300))
    assert "Python" not in plan(got) and "MapInPandas" not in plan(got)
    for r in got.limit(700).collect():
        k = r["event_id"]
        assert bytes(r["content"]) == (b"x" * 9 if k % 3 == 0 else au.wav(np.zeros(k % 300, np.float32)))


def test_enrollments_are_decoded_and_cut_in_one_step(spark):
    from sonoframe.sources import audio as sources

    rows = spark.createDataFrame([("a", base64.b64encode(au.wav(np.full(900, 0.5, np.float32))).decode(), "wav")], "session_id string, audio_b64 string, format string")
    got = sources.enrollments(rows, Params().override({"enrollment_min_sec": 0.01, "enrollment_max_sec": 0.05}))
    assert got.select("seconds").first()[0] == 0.05
    assert plan(got).count("ArrowEvalPython") == 1


def test_wide_files_are_made_without_python(spark):
    vectors = spark.createDataFrame([(k, [-1.0, -0.3, 0.0, 0.25, 0.9999, 1.0]) for k in range(8)], "vec_id long, embedding array<float>")
    got = live.wide_files(vectors)
    assert "Python" not in plan(got) and "MapInPandas" not in plan(got)
    for r in got.collect():
        k, data = r["vec_id"], bytes(r["content"])
        width, channels = k % 4 + 1, 1 if k < 4 else 2
        full = 2 ** (8 * width - 1) - 1
        want = [int(float(np.float32(x)) * full) + (128 if width == 1 else 0) for x in (-1.0, -0.3, 0.0, 0.25, 0.9999, 1.0)]
        rest = [128 if width == 1 else 0] * (channels - 1)
        body = b"".join(v.to_bytes(width, "little", signed=width > 1) for x in want for v in (x, *rest))
        form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, au.RATE, au.RATE * width * channels, width * channels, 8 * width)
        assert data == struct.pack("<4sI4s", b"RIFF", 36 + len(body), b"WAVE") + form + struct.pack("<4sI", b"data", len(body)) + body


def test_sums_hold_one_clip_at_a_time(spark):
    """Memory that sums of a batch of clips take beside the batch, in a task."""

    def measured(batches):
        import tracemalloc

        for b in batches:
            tracemalloc.start()
            sound.with_sums_of(b)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            yield pd.DataFrame({"peak": [peak], "bytes": [int(b["pcm"].map(len).sum())]})

    clips = spark.range(2000).repartition(1).select(F.expr("cast(repeat('ab', 2000) as binary)").alias("pcm"))
    assert all(r["peak"] < r["bytes"] / 4 for r in clips.mapInPandas(measured, "peak long, bytes long").collect())


def test_workers_that_decode_and_normalize_load_no_pandas(tmp_path):
    """In a job of its own, as workers are used again: what a worker has loaded once it has decoded clips and brought texts to NFKC."""
    import json
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import json, sys
from pyspark.sql import SparkSession, functions as F
from sonoframe.functions import audio as au, text
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.local.dir", {str(tmp_path)!r}).config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
clips = [(bytearray(au.wav([0.5] * 3)), "\uff21"), (bytearray(b"x"), "a"), (bytearray(au.wav([])), None), (None, "")]
got = spark.createDataFrame(clips, "content binary, said string").coalesce(1).select(au.decode_wav("content").alias("d"), text.nfkc("said").alias("said"))
got = got.select("d.*", "said", au.encode_wav("d.pcm").alias("file"), au.frame_probs("d.pcm").alias("probs")).collect()
loaded = F.udf(lambda _: "pandas" in sys.modules, "boolean")
hexed = lambda x: None if x is None else x.hex()
rows = [[hexed(r["pcm"]), r["seconds"], r["error"], r["said"], hexed(r["file"])] for r in got]
assert [r["probs"] for r in got] == [[]] * 4
assert [r["p"] for r in spark.createDataFrame([(bytearray(b"\\0\\x40" * 400),), (None,), (bytearray(160 * 2),)], "pcm binary").coalesce(1).select(au.frame_probs("pcm").alias("p")).collect()] == [[1.0, 1.0], [], [0.0]]
print(json.dumps({{"rows": rows, "pandas": [r[0] for r in spark.range(1).select(loaded("id")).collect()]}}))
"""
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(root), "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    said = json.loads(done.stdout.splitlines()[-1])
    assert said["pandas"] == [False]
    heard = au.to_pcm16(au.read_wav(au.wav([0.5] * 3)))
    assert said["rows"] == [
        [heard.hex(), 3 / 16000, None, "A", au.wav(au.pcm16(heard)).hex()],
        [None, None, "decode_failed", "a", None],
        ["", 0.0, None, None, au.wav([]).hex()],
        [None, None, "decode_failed", "", None],
    ]

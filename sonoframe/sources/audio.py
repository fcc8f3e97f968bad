"""Sources of sound and settings: uploaded files, enrollments, raw PCM streams, synthetic clips, JSON settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.operators.vad import Machine, Rules
from sonoframe.params import Params

FRAMES = "session_id string, seq long, payload binary"


def read_uploads(spark: SparkSession, path: str, params: Params = Params()) -> DataFrame:
    """(path, pcm, seconds, error) of each file: empty, too_large, decode_failed, empty_audio, or its samples, capped at the tail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return validate_uploads(files, params)


def validate_uploads(files: DataFrame, params: Params = Params()) -> DataFrame:
    """As read_uploads(), of rows (path, length, content). Files that fail a check aren't decoded."""
    early = F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty").when(F.col("length") > params.upload_max_bytes, "too_large")
    df = files.select("path", early.alias("early"), F.when(early.isNull(), F.col("content")).alias("content"))
    df = df.withColumn("got", au.decode_wav("content"))
    pcm = au.tail_cap_pcm(F.col("got.pcm"), params.upload_max_sec)
    return df.select("path", F.when(F.col("early").isNull(), pcm).alias("pcm"), F.when(F.col("early").isNull(), F.octet_length(pcm) / (2 * au.RATE)).alias("seconds"), F.coalesce("early", "got.error", F.when(F.col("got.seconds") == 0, "empty_audio")).alias("error"))


def read_raw_pcm(spark: SparkSession, path: str) -> DataFrame:
    """(path, pcm) of raw 16-bit files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("pcm"))


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (session_id, seq, payload) Parquet rows."""
    return spark.readStream.schema(FRAMES).parquet(path)


def enrollments(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """(session_id, pcm, seconds, error) of (session_id, audio_b64, format): too long a clip is cut to its voiced part."""
    fmt = F.lower(F.trim(F.coalesce(F.nullif("format", F.lit("")), F.lit("wav"))))
    early = F.when(F.coalesce("audio_b64", F.lit("")) == "", "missing").when(fmt != "wav", "unsupported_format")
    content = F.when(early.isNull(), F.try_to_binary("audio_b64", F.lit("base64")))
    df = rows.select("session_id", early.alias("early"), content.alias("content")).withColumn("got", au.decoder(trim_voiced(params))("content"))
    seconds = F.octet_length("got.pcm") / (2 * au.RATE)
    short = F.when(F.col("got.seconds") == 0, "empty").when(seconds < params.enrollment_min_sec, "too_short")
    error = F.coalesce("early", "got.error", short)
    return df.select("session_id", F.when(error.isNull(), F.col("got.pcm")).alias("pcm"), F.when(error.isNull(), seconds).alias("seconds"), error.alias("error"))


def trim_voiced(params: Params) -> Callable[[bytes], bytes]:
    """What cuts 16-bit samples over the longest enrollment to their first voiced part of that length."""
    target, rules, hop = int(params.enrollment_max_sec * au.RATE), Rules.of(params), params.hop

    def cut(data: bytes) -> bytes:
        if len(data) <= 2 * target:
            return data
        machine, spans = Machine(rules), []
        for p in au.energy_prob(au.frame_energy(au.pcm16(data), hop)).tolist():
            spans.append(machine.step(p))
        spans.append(machine.flush())
        voiced = b"".join(data[2 * hop * s[0] : 2 * hop * (s[1] + 1)] for s in spans if s)
        return (voiced or data)[: 2 * target]

    return cut


def pcm_frames(clips: DataFrame, session: str = "session_id", pcm: str = "pcm") -> DataFrame:
    """(session, frame_idx, prob): each whole 10 ms frame's speech probability."""
    return clips.select(session, F.posexplode(au.frame_probs(pcm))).select(session, F.col("pos").cast("long").alias("frame_idx"), F.col("col").alias("prob"))


def synthetic_clips(spark: SparkSession, n: int, seconds: float, kind: str = "sine", *, distinct: bool = True) -> DataFrame:
    """(clip_id, content): WAV files made on the executors."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"clip_id": b["id"], "content": [au.wav(au.tone(seconds, kind, int(i) if distinct else 0)) for i in b["id"]]})

    return spark.range(n).mapInPandas(make, "clip_id long, content binary")


def cut_segments(clips: DataFrame, segments: DataFrame, params: Params = Params(), session: str = "session_id") -> DataFrame:
    """``segments`` with the 16-bit samples of their frames."""
    size = 2 * params.hop
    joined = segments.join(clips.select(session, "pcm"), session)
    return joined.withColumn("pcm", F.substring(F.col("pcm"), F.col("start_frame").cast("int") * size + 1, (F.col("end_frame") - F.col("start_frame") + 1).cast("int") * size))


def read_settings(spark: SparkSession, path: str) -> Params:
    """Settings from a JSON file; a file that isn't there gives the defaults."""
    folder, _, name = path.rpartition("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder or ".")
    rows = files.limit(1).collect() if name else []
    return Params.load(bytes(rows[0]["content"]).decode() if rows else None)


def silent_frames(n: int) -> bytes:
    return np.zeros(n, "<i2").tobytes()

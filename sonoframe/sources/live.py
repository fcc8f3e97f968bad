"""Sessions of the four live tasks as one stream, from captures: lines of JSON, a text message or bytes in each.

The stream is Spark's file source: it takes new files as they come, keeps in its checkpoint which it has taken, and so
reads each line once when it is killed and started again. All tasks share one schema; a task's name says its rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples a second that a task's clients send.
RATES = {"asr": 16_000, "tsasr": 16_000, "emotion": 16_000, "demo": 48_000}
CAPTURE = "session_id string, seq long, at timestamp, text string, audio_b64 string"
#: Kinds of control messages by their type; others are none of ours.
KINDS = {"start": "start", "stop": "stop", "update_hotwords": "control"}


def rows_of(captures: DataFrame) -> DataFrame:
    """(session_id, seq, at, kind, payload, body) of lines CAPTURE; what is neither sound nor a known message keeps its place, as kind ``ignored``.

    Of messages, ``hotwords`` and the language under its names are kept as ``body``.
    """
    message = F.col("text")
    kind_of = F.get_json_object(message, "$.type")
    known: Column = F.lit("ignored")
    for name, kind in KINDS.items():
        known = F.when(kind_of == name, F.lit(kind)).otherwise(known)
    kind = F.when(F.col("audio_b64").isNotNull(), "frame").otherwise(known)
    words = F.from_json(F.get_json_object(message, "$.hotwords"), "array<string>")
    language = F.coalesce(F.get_json_object(message, "$.language"), F.get_json_object(message, "$.src_lang"))
    body = F.when(kind.isin("start", "control"), F.to_json(F.struct(words.alias("hotwords"), language.alias("language"))))
    return captures.select("session_id", "seq", "at", kind.alias("kind"), F.try_to_binary("audio_b64", F.lit("base64")).alias("payload"), body.alias("body"))


def task_stream(spark: SparkSession, path: str, task: str, *, files_per_batch: int | None = None) -> tuple[DataFrame, int]:
    """A task's rows from the captures under ``path``, and the rate of their sound."""
    if task not in RATES:
        raise ValueError(f"unknown task: {task}")
    reader = spark.readStream.schema(CAPTURE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return rows_of(reader.json(path)), RATES[task]

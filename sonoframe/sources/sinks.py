"""Where results go: JSON lines, WAV files in tables, and delivery of streams, once a message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sonoframe.functions.audio import encode_wav


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; null members are left out."""
    df.write.mode("overwrite").json(path)


def with_wav(clips: DataFrame, pcm: str = "pcm") -> DataFrame:
    """``clips`` with their samples as a WAV file and as its base64 text."""
    return clips.withColumn("wav", encode_wav(pcm)).withColumn("audio_b64", F.base64("wav"))


def deliver(messages: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch to ``send``; a batch that is run again has the same number."""
    return messages.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def deliver_once(messages: DataFrame, path: str, checkpoint: str, *, send: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer to a table in which each message is once, however often a batch is run again.

    A micro-batch is a folder named by its number, written whole and replaced by a rerun. ``send``, if given, gets a
    batch's rows as stored, after they are; a batch that it finished has a mark and is never handed to it again, one
    that it failed in is handed to it again with the same number and the same rows.
    """
    spark = messages.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def marked(batch: int):
        mark = fs_path(f"{path}/_sent/{batch}")
        return mark, mark.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(rows: DataFrame, batch: int) -> None:
        mark, files = marked(batch)
        if files.exists(mark):
            return
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if send is not None:
            send(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={batch}"), batch)
        files.create(mark, True).close()

    return deliver(messages, put, checkpoint)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """What deliver_once() wrote, with the number of its ``batch``."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)

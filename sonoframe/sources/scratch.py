"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; in local mode without either a temporary one. Elsewhere there is none to guess: ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
            current = context._jsc.sc().getCheckpointDir()
        found = current.get()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table of the shared folder: lost executors don't lose them, and the plan behind them is cut. It goes with drop(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    atexit.register(drop, found)
    return found


def drop(df: DataFrame) -> None:
    """Removes what stored() wrote; a driver that is shutting down can't, and needn't."""
    path = getattr(df, "_stored_at", None)
    if path is None:
        return
    with contextlib.suppress(Exception):
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    df._stored_at = None

"""What the operators share: the shared folder, lineage cuts, and hashes that any worker repeats."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, the context's checkpoint folder; in local mode without one, a temporary folder.
    On a cluster there is no folder to guess, so this raises ValueError.
    """
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


#: Paths that scratch() gave and nobody dropped yet.
_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by sweep(), or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    atexit.register(drop, spark, path)
    return path


def sweep(spark: SparkSession, held: list[str]) -> None:
    """Drop all scratch tables but ``held``: for the end of a step whose result is stored."""
    for path in [p for p in _scratch if p not in held]:
        drop(spark, path)


def scratch_paths() -> list[str]:
    return list(_scratch)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path that scratch() gave. A driver that is already shutting down can't, and needn't."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _scratch:
            _scratch.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: they survive lost executors and cut the lineage. What is such a table already stays as it is."""
    if stored_at(df) is not None:
        return df
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def stored_at(df: DataFrame) -> str | None:
    """Where written() put exactly these rows."""
    return getattr(df, "_stored_at", None)


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of


#: Rows that a step in Python works on at once: texts can be long, and their objects take several times their bytes.
BATCH_ROWS = 1000


def pieces(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Bytes and rows of an Arrow batch for steps whose rows are large.
SMALL_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For the time of a block, jobs that start in it hand rows to Python a few megabytes at once; the session's settings come back after it."""
    before = {k: spark.conf.get(k) for k in SMALL_BATCH}
    for k, v in SMALL_BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as ``doc`` beside the given columns, so that no column of ``docs`` clashes with an operator's own."""
    return docs.select(F.struct(*docs.columns).alias("doc"), *[c.alias(name) for name, c in columns.items()])


#: The column that numbered() adds.
ROW = "_row"


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with a number for each row that grows with the id; and whether that is the id itself, as it is if no id is null or repeated.

    Otherwise the rows are written in order of id and a hash of the text, null ids last, and numbered as written.
    """
    key = F.col(id_col).cast("long")
    odd = docs.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").limit(1).count()
    if not odd:
        return docs.withColumn(ROW, key), True
    order = [key.asc_nulls_last(), F.xxhash64(text_col)]
    dealt = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.withColumn(ROW, F.monotonically_increasing_id()), "numbered"), False


#: The one large thing that this Python worker keeps between tasks: (kind, key, value).
_resident: list[tuple[str, Hashable, Any]] = []


def resident(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for this worker's next tasks of the same kind and key. What was kept before goes first, so a worker that serves several steps holds one step's models only."""
    if not _resident or _resident[0][:2] != (kind, key):
        vacate()
        _resident.append((kind, key, make()))
    return _resident[0][2]


def vacate() -> None:
    """Lets go of what resident() keeps, and gives free memory back to the system: for tasks that need room."""
    _resident.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)

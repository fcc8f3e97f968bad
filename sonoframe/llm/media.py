"""Media columns: payloads in baseline JPEG files, and what a decoder of those files finds.

``store_payloads`` turns texts into files (a binary column), losslessly; ``media_features`` parses the files,
decodes their scans and gives dimensions, a DC-only luminance thumbnail and its hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import jpeg
from sonoframe.llm.common import pieces

UNIT = 64
#: Payload bytes that a worker codes at once.
CHUNK = 1 << 20

MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("media", T.BinaryType())])
FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("thumb_crc32", T.LongType()),
        T.StructField("thumb_hash", T.StringType()),
    ]
)


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store_payloads(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One grey baseline JPEG for each row: its UTF-8 text, padded with zero bytes to a positive multiple of 64.

    A null text is empty; the file's comment holds the unpadded length. Rows with equal texts get equal files,
    repeated and null ids are kept as they are, and other columns are left out.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, texts = batch.column(0), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks([len(t) for t in texts]):
                part = texts[a:b]
                files = jpeg.encode([padded(t) for t in part], [str(len(t)).encode() for t in part])
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Decode (doc_id, media) files that store_payloads made: what they hold, their dimensions and thumbnail hashes.

    A null file gives nulls; a damaged one raises.
    """

    def describe(doc_id, blob: bytes, image: jpeg.Image, coefficients: np.ndarray) -> tuple:
        payload = jpeg.payload_of(image, coefficients)
        thumb = jpeg.thumbnail(image, coefficients)
        crc, mark = zlib.crc32(thumb.tobytes()), jpeg.average_hash(thumb)
        return (
            doc_id, int(image.comment), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(),
            f"{image.width}x{image.height}:{mark}:{crc:08x}", image.width, image.height, crc, mark,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(FEATURES)
        for batch in pieces(batches):
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([len(x or b"") for x in blobs]):
                there = [i for i in range(a, b) if blobs[i] is not None]
                found = dict(zip(there, jpeg.decode([blobs[i] for i in there]), strict=True))
                rows = [describe(ids[i], blobs[i], *found[i]) if i in found else (ids[i], *[None] * (len(FEATURES) - 1)) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return media.select("doc_id", "media").mapInArrow(read, FEATURES)

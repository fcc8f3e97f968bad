"""Token ids as length-delimited binary records, with masked checksums and an offset index.

A record file is a run of frames, one for each document::

    uint64 length | uint32 masked crc32(length) | payload | uint32 masked crc32(payload)

all little-endian; the payload is the ids as uint16 (uint32 for vocabularies of over 65,536 ids).
The checksum is CRC-32 (IEEE), rotated and offset so that checksums of data that hold checksums
stay apart. The index is a separate Parquet table with one row for each record, so that a shuffled
reader seeks straight to the frames that it wants.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.common import partitions, pieces, resident

MASK_DELTA = 0xA282EAD8
INDEX = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Pieces of either kind whose ids a worker keeps; frequent pieces come early, so later ones go uncached.
CACHED_PIECES = 400_000
#: Bytes of text for a record file, and so for a task.
FILE_BYTES = 128 << 20

#: Fixed by the vocabulary: white space, and its pattern of pre-tokens where letters are those of ASCII, Latin-1 and
#: Latin Extended-A and -B, and digits are 0 to 9.
SPACES, LETTERS = r" \t\n\x0b\x0c\r", "A-Za-zÀ-ÖØ-öø-ɏ"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Texts that this pattern splits as the vocabulary's own does.
PLAIN = re.compile(f"[\x00-\x7f{LETTERS}¡¢£§©«®°±»¿×÷–—‘’“”„•…‹›€]*")


def id_type(vocabulary: int) -> str:
    """The numpy type of stored ids."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises ValueError if a length or checksum is wrong."""
    if len(data) < 16:
        raise ValueError("record is cut short")
    head, (crc,) = data[:8], struct.unpack("<I", data[8:12])
    (n,) = struct.unpack("<Q", head)
    if masked_crc(head) != crc or len(data) != n + 16:
        raise ValueError("record length is damaged")
    payload = data[12:-4]
    if masked_crc(payload) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("record payload is damaged")
    return payload


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Ids(dict):
    """Ids of pieces, as bytes; a piece that isn't kept is made by ``make``, and kept while there is room."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        found = self.make(piece)
        if len(self) < CACHED_PIECES and len(piece) <= 64:
            self[piece] = found
        return found


class Encoder:
    """Ids of whole texts, by pieces that a worker encodes once.

    Texts in ``PLAIN`` characters are split into pre-tokens, as the vocabulary's own pattern says, and the model
    encodes those. Elsewhere a space between two characters that aren't white space always begins a pre-token:
    other texts are cut there, and the tokenizer encodes what isn't plain.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.letters = Tokenizer.from_file(path), dtype, byte_letters()
        if self.tokenizer.get_vocab_size() > np.iinfo(np.dtype(dtype)).max + 1:
            raise ValueError(f"ids of {path} don't fit into {dtype}")
        # the pattern above is that of byte-level vocabularies without a normal form; others take the slow way
        rules = json.loads(self.tokenizer.to_str())
        split = rules.get("pre_tokenizer") or {}
        self.fast = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not (rules.get("post_processor") or {}).get("add_prefix_space")
        self.model = self.tokenizer.model
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokens, self.pieces = Ids(self.token), Ids(self.piece)

    def token(self, token: str) -> bytes:
        spelled = token.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], dtype=self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that begin with the space before them, cut only between characters that aren't white space."""
        parts = text.split(" ")
        out, held = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for part in parts[1:]:
            if held or not part or part[0].isspace():
                out[-1] += " " + part
            else:
                out.append(" " + part)
            held = not part or part[-1].isspace()
        return out

    def encode(self, text: str) -> bytes:
        if not self.fast:
            return self.piece(text)
        if self.plain(text):
            return b"".join(map(self.tokens.__getitem__, PRE_TOKEN.findall(text)))
        return b"".join([self.encode(p) if self.plain(p) else self.pieces[p] for p in self.cut(text)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) if t else b"" for t in texts]


def encoder(path: str, dtype: str) -> Encoder:
    """This Python worker's encoder, kept between tasks."""
    return resident("encoder", (path, dtype), lambda: Encoder(path, dtype))


def slices(texts: list[str | None], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` characters each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_records(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int | None, vocabulary: int = 50_257, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode ``docs``, write record files under ``folder`` in ascending id order, and return the index.

    Rows are dealt by ranges of the id, so files in order of ``part`` hold ascending ids; repeated ids
    are ordered by a hash of their texts, null ids come first. Null texts are empty; every document ends with
    ``end_id`` unless that is None. The index is itself written to ``folder``/index, with one row for
    each document. A task writes to a name of its own and renames at the end, so a task that is run
    again or twice leaves one whole file. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    dtype = id_type(vocabulary)
    end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
    width = np.dtype(dtype).itemsize
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ranges are found from a sample of the keys that reaches the driver, so no text is one
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    if parts is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(partitions(spark), -(-n_bytes // FILE_BYTES))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, filesystem, sink, seq, offset = task.partitionId(), None, None, 0, 0
        name = f"part-{part:06d}.rec"
        tmp = f"_{name}.{task.taskAttemptId()}"
        encode = encoder(tokenizer, dtype)
        out = []
        for batch in pieces(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            offsets, sizes, tokens = [], [], []
            if sink is None and texts:
                filesystem, base = fs.FileSystem.from_uri(folder)
                filesystem.create_dir(base, recursive=True)
                sink = filesystem.open_output_stream(posixpath.join(base, tmp))
            for a, b in slices(texts):
                for payload in encode(texts[a:b]):
                    data = frame(payload + end)
                    sink.write(data)
                    offsets.append(offset)
                    sizes.append(len(data))
                    tokens.append((len(data) - 16) // width)
                    offset += len(data)
            n = len(texts)
            out.append(pa.RecordBatch.from_arrays([ids, pa.array([name] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=INDEX.fieldNames()))
            seq += n
        if sink is not None:
            sink.close()
            filesystem.move(posixpath.join(base, tmp), posixpath.join(base, name))
        yield from out

    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, schema: T.StructType, each) -> DataFrame:
    """Read the frames that ``index`` points to, in any order; ``each`` turns (index columns, payloads) into columns of ``schema``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        opened: dict[str, fs.NativeFile] = {}
        for batch in pieces(batches, 512):
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            payloads = []
            for name, offset, n in zip(cols["file"], cols["offset"], cols["n_bytes"], strict=True):
                if name not in opened:
                    for other in opened.values():
                        other.close()
                    opened = {name: filesystem.open_input_file(posixpath.join(base, name))}
                opened[name].seek(offset)
                payloads.append(unframe(opened[name].read(n)))
            yield pa.RecordBatch.from_pydict(each(cols, payloads), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return index.mapInArrow(read, schema)


def document_starts(index: DataFrame) -> DataFrame:
    """Ids of all earlier documents for each index row. One row a file reaches the driver, none for documents."""
    spark = index.sparkSession
    per_file = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for row in per_file:
        bases.append((row["part"], total))
        total += row["n"]
    base = spark.createDataFrame(bases, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = 0, None
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n_tokens").to_numpy()
            new = np.flatnonzero(np.diff(part, prepend=-1 if at is None else at))
            cum = np.concatenate(([0], np.cumsum(n)))
            shift = np.full(len(part), held, dtype=np.int64)
            for i in new:
                shift[i:] = -cum[i]
            start = cum[:-1] + shift
            if len(part):
                held, at = int(start[-1] + n[-1]), int(part[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "in_part"])

    schema = T.StructType([*INDEX.fields, T.StructField("in_part", T.LongType())])
    dealt = index.repartition(max(1, len(bases)), "part").sortWithinPartitions("part", "seq").mapInArrow(run, schema)
    return dealt.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("in_part")).drop("base", "in_part")


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def token_digests(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int | None, vocabulary: int = 50_257) -> DataFrame:
    """Write ``docs`` as record files, read them back, and describe each document by what was read."""
    dtype = id_type(vocabulary)
    index = document_starts(write_records(docs, folder, tokenizer=tokenizer, end_id=end_id, vocabulary=vocabulary))

    def each(cols: dict, payloads: list[bytes]) -> dict:
        ids = [np.frombuffer(p, dtype=dtype).astype("<u4") for p in payloads]
        return {"doc_id": cols["doc_id"], "start": cols["start"], "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}

    return read_records(index, folder, DIGEST, each)

"""Best-fit packing of token sequences into bins of several permitted lengths.

Texts longer than the largest capacity are cut into pieces of it and a rest. Pieces are dealt to shards by a hash
of their document and packed best-fit decreasing within each shard: a piece goes to the open bin that it leaves
least room in; failing that, the capacity whose bin costs least for what is still to come is opened; at the end
every bin is downsized to the least permitted length that holds its contents. Shards hold a bounded number of
pieces, however many there are in all, so packing has no task that grows with the corpus, and at that size the
loss against packing all pieces together is a fraction of a bin a shard.

Pieces carry their token ids, and where in their document they begin: sequences() puts a bin's pieces together, with
the places where documents begin in it.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import records
from sonoframe.llm.common import WORD, small_batches, vacate, written
from sonoframe.llm.common import pieces as batched

CAPACITIES = (512, 1024, 2048, 4096)
#: A bin's cost in tokens: its length, what a sequence costs whatever its length, and attention, which grows with the square.
BIN_COST, ATTENTION = 64, 16_384
SHARD_PIECES = 2_500

PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("copy", T.LongType()),
        T.StructField("piece", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("bin_id", T.LongType()),
        T.StructField("bin_offset", T.LongType()),
        T.StructField("capacity", T.LongType()),
        T.StructField("used", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])


def opening(length: int, waiting: Counter, sizes: list[int], capacities: tuple[int, ...], bin_cost: int) -> int:
    """The capacity to open for a piece: the least cost for a token, if it is filled up best-fit by what waits."""
    best = None
    for capacity in capacities:
        if capacity < length:
            continue
        room, filled, taken = capacity - length, length, Counter()
        while room:
            # the longest waiting piece that fits
            i = bisect.bisect_right(sizes, room) - 1
            while i >= 0 and waiting[sizes[i]] - taken[sizes[i]] <= 0:
                i -= 1
            if i < 0:
                break
            taken[sizes[i]] += 1
            room -= sizes[i]
            filled += sizes[i]
        # at the end the bin shrinks to its contents
        final = next(c for c in capacities if c >= filled)
        cost = (final + bin_cost + final * final / ATTENTION) / filled
        if best is None or cost < best[0] - 1e-12:
            best = (cost, capacity)
    return best[1]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each length, and each bin's final capacity and contents. Lengths are 1 to the largest capacity."""
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    waiting = Counter(lengths)
    sizes = sorted(waiting)
    where, offset = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    rooms: list[int] = []  # rooms of open bins, sorted
    at_room: dict[int, list[int]] = {}
    for i in order:
        n = lengths[i]
        waiting[n] -= 1
        if not waiting[n]:
            del waiting[n]
            sizes.pop(bisect.bisect_left(sizes, n))
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = at_room[room].pop()
            if not at_room[room]:
                rooms.pop(k)
        else:
            b = len(used)
            used.append(0)
            room = opening(n, waiting, sizes, capacities, bin_cost)
        where[i], offset[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            if not at_room.get(room):
                bisect.insort(rooms, room)
                at_room[room] = []
            at_room[room].append(b)
    return where, offset, [capacities[bisect.bisect_left(capacities, u)] for u in used], used


def word_count(text_col: str = "text"):
    """Words of a text: the length that a pipeline without a tokenizer packs by."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, *, vocabulary: int = 50_257, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each row's token ids as little-endian numbers, with ``end_id`` after them; a null text is empty."""
    dtype = records.id_type(vocabulary)
    end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()

    def run(batches):
        encode = records.encoder(tokenizer, dtype)
        for batch in batched(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in records.slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([ids + end for ids in encode(texts[a:b])], pa.binary())], names=ENCODED.fieldNames())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def cut(rows: DataFrame, largest: int, width: int) -> DataFrame:
    """(doc_id, copy, piece, start, n_tokens, ids): rows (doc_id, n, ids) cut at ``largest`` tokens. ``copy`` tells repeated ids apart."""
    # equal rows are told apart by a number within their task, which a rerun repeats because the rows are written first
    with small_batches(rows.sparkSession):
        rows = written(rows.where("n > 0").withColumn("copy", F.monotonically_increasing_id()), "lengths")
    count = F.expr(f"int((n + {largest - 1}) div {largest})")
    start = F.col("piece").cast("long") * largest
    size = F.least(F.lit(largest), F.col("n") - start).cast("int")
    ids = F.col("ids").substr((start * width + 1).cast("int"), size * width)
    return rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1))).select("doc_id", "copy", F.col("piece").cast("long"), start.alias("start"), size.cast("long").alias("n_tokens"), ids.alias("ids"))


def pack_documents(
    docs: DataFrame, *, tokenizer: str | None = None, end_id: int | None = None, vocabulary: int = 50_257, length=None, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id"
) -> DataFrame:
    """One row for each piece of each row of ``docs``: where it begins in the row, its bin, its offset there, the bin's length and contents, and its ids.

    With ``tokenizer``, the path of a byte-level vocabulary, pieces hold the token ids of ``text``, as little-endian
    numbers of two bytes (four for vocabularies of over 65,536 ids), each row's ending with ``end_id`` unless that is
    None. Otherwise ``length`` is a column of token counts (words of ``text`` by default), and ids are null.
    Rows of no token or of a null length take no room and give no piece; with an end id every row has a token. Rows
    with equal or null ids are packed one by one; ``copy`` tells them apart. An empty table gives no rows.
    """
    largest, width = max(capacities), np.dtype(records.id_type(vocabulary)).itemsize
    if tokenizer is not None:
        rows = encoded(docs, tokenizer, end_id, vocabulary=vocabulary, id_col=id_col).select("doc_id", (F.octet_length("ids") / width).cast("long").alias("n"), "ids")
    else:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (word_count() if length is None else length).cast("long").alias("n"), F.lit(None).cast("binary").alias("ids"))
    every = cut(rows, largest, width)
    shards = max(1, math.ceil(every.count() / shard_pieces))

    def solve(group):
        vacate()  # packing needs no tokenizer, nor what a group before left
        group = group.take(pa.array(np.lexsort((group.column("piece").to_numpy(), group.column("copy").to_numpy()))))
        where, offset, capacity, used = pack(group.column("n_tokens").to_pylist(), capacities, bin_cost)
        base = group.column("shard")[0].as_py() << 32
        found = [group.column(c) for c in ("doc_id", "copy", "piece", "start", "n_tokens")]
        return pa.Table.from_arrays([*found, pa.array([base + b for b in where], pa.int64()), pa.array(offset, pa.int64()), pa.array([capacity[b] for b in where], pa.int64()), pa.array([used[b] for b in where], pa.int64()), group.column("ids")], names=PACKED.fieldNames())

    dealt = every.withColumn("shard", F.pmod(F.xxhash64("copy", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(solve, PACKED)


def sequences(packed: DataFrame) -> DataFrame:
    """(bin_id, capacity, used, ids, documents): each bin's ids, and (doc_id, start, offset, n_tokens) of its pieces in order. A bin is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "start", "n_tokens", "ids")))
    held = packed.groupBy("bin_id", "capacity", "used").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    documents = F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["bin_offset"].alias("offset"), x["n_tokens"].alias("n_tokens")))
    return held.select("bin_id", "capacity", "used", ids.alias("ids"), documents.alias("documents"))

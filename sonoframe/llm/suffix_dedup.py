"""Removal of repeated byte strings, by sorting a difference cover of the corpus's suffixes.

A position is in the cover if its offset in its text, modulo 73, is in a perfect difference set: for any two places
there is exactly one shift below 73 at which both are covered. So two equal 100-byte strings are covered at a same
offset, with at least 28 of their bytes from there on.

1. Triples: a covered position's name stands for the triple of 8-byte words there. Names are dealt by value, sorted,
   and those that occur once leave: their strings can't repeat. Only flags go back, one bit a name.
2. Recursion on names: a name that is left is extended to the triple of what precedes it, itself and what follows
   it, 172 bytes in all. Those are all bytes that a 100-byte string around it can have, so no deeper level could tell
   more. Triples are dealt by the first level's name, sorted and named again: of equal ones all but the first place
   repeat, and the first places of names with several triples stay open.
3. Merging: the open places of one name are sorted by the suffixes that begin there and by the reversed prefixes that
   end there. Bytes in common with the neighbour give names for every length of prefix. A position that isn't covered
   is merged by the bytes before its covered one and that one's name: two 100-byte strings are equal if both are.
   In each class of equal strings, all but the first are removed.

Texts are held in slices, each a row of a table in the shared folder. Between slices and names only arrays of small
numbers are shuffled. Names that many slices have are dealt by their triples; open places that are too many for one
task have their strings dealt one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.common import ROW, drop, numbered, partitions, pieces, scratch_paths, small_batches, stored_at, sweep, vacate, written

LENGTH = 100
#: The perfect difference set of order 8: each residue but 0 is the difference of exactly one pair.
MODULUS, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)
#: A covered position has at most BEFORE bytes of a string before it, and LEAST of one from it on.
BEFORE = MODULUS - 1
LEAST = LENGTH - BEFORE
#: Bytes of text in a slice (a longer text is a slice of its own), and for each task that names are dealt to.
SLICE_BYTES, NAMED_BYTES = 2 << 20, 16 << 20
#: Names that so many slices have are dealt by their triples; one of fewer is little to a task that holds millions.
HOT_SLICES = 1000
#: Open places of one name that a task sorts; beyond, strings are dealt by their hash.
GRAM_CLASSES = 20_000
TASK_CLASSES = 40_000

SLICE = T.StructType([T.StructField("slice", T.LongType()), T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("z", T.BinaryType())])
NAMES = T.StructType([T.StructField("slice", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("low", T.ArrayType(T.IntegerType()))])
FLAGS = T.StructType([T.StructField("slice", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("again", T.BinaryType()), T.StructField("hot", T.BinaryType())])
#: Triples of names: those of hot names come with the whole name, others with what the task leaves open of it.
TRIPLES = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("low", T.ArrayType(T.IntegerType())),
        T.StructField("whole", T.ArrayType(T.LongType())),
        T.StructField("around", T.ArrayType(T.LongType())),
        T.StructField("row", T.ArrayType(T.LongType())),
        T.StructField("place", T.ArrayType(T.IntegerType())),
    ]
)
#: How open places of one name are solved: in one task, string by string, or by which of both their number calls for.
LIGHT, HEAVY, SPREAD = 0, 1, 2
#: Of a slice's covered positions, by number: those that repeat, and the open ones of one kind with their names.
FOUND = T.StructType([T.StructField("slice", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("again", T.ArrayType(T.IntegerType())), T.StructField("open", T.ArrayType(T.IntegerType())), T.StructField("gram", T.ArrayType(T.LongType()))])
AROUND = T.StructType([T.StructField("gram", T.LongType()), T.StructField("slice", T.LongType()), T.StructField("row", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("low", T.ShortType()), T.StructField("bytes", T.BinaryType())])
SPANS = T.StructType([T.StructField("slice", T.LongType()), T.StructField("row", T.ArrayType(T.LongType())), T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("stop", T.ArrayType(T.IntegerType()))])
STRING = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("slice", T.LongType())])
CLEANED = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def slices(rows: DataFrame) -> DataFrame:
    """Texts of (row, text), compressed by slices; in a slice they are in order of row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            row, data = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), pa.array([list(row)], pa.list_(pa.int64())), pa.array([[len(x) for x in data]], pa.list_(pa.int32())), pa.array([squeeze(b"".join(data))], pa.binary())], names=SLICE.fieldNames())

        for batch in pieces(batches):
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if held and size + len(data or b"") > SLICE_BYTES:
                    yield flush()
                    held, size, made = [], 0, made + 1
                held.append((row, data or b""))
                size += len(data or b"")
        if held:
            yield flush()

    return rows.select("row", "text").mapInArrow(run, SLICE)


class Slice:
    """A slice's text, the places of its texts, and its covered positions in order of (row, at)."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        import zstandard

        self.number = batch.column("slice")[i].as_py()
        self.rows = batch.column("rows")[i].values.to_numpy()
        self.sizes = batch.column("sizes")[i].values.to_numpy().astype(np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(batch.column("z")[i].as_buffer())
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def cover(self, places: np.ndarray | None = None) -> None:
        """Find the covered positions that LENGTH bytes can lie around, or those with the given numbers only."""
        top = int(self.sizes.max(initial=0))
        steps = np.add.outer(np.arange(0, top, MODULUS), np.array(COVER)).ravel()
        counts = np.where(self.sizes >= LENGTH, np.searchsorted(steps, self.sizes - LEAST, side="right"), 0)
        first = np.cumsum(counts) - counts
        if places is None:
            self.doc = np.repeat(np.arange(len(counts)), counts)
            self.at = steps[np.arange(len(self.doc)) - np.repeat(first, counts)]
        else:
            self.doc = np.searchsorted(first + counts, places, side="right")
            self.at = steps[places - first[self.doc]]
        self.flat = self.begin[self.doc] + self.at
        self.low, self.high = np.minimum(self.at, BEFORE), np.minimum(self.sizes[self.doc] - self.at, LENGTH)

    def names(self) -> np.ndarray:
        """A 64-bit name of the triple of words at each covered position."""
        if not len(self.flat):
            return np.zeros(0, dtype=np.uint64)
        words = np.ndarray((len(self.text) - 7,), dtype="<u8", buffer=self.text, strides=(1,))
        h = np.full(len(self.flat), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for k, odd in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9FB21C651E98DF25)):
            h = (h ^ words[self.flat + 8 * k]) * np.uint64(odd)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def task_of(hashes: np.ndarray, tasks: int) -> np.ndarray:
    """The task that a 64-bit hash is dealt to; it grows with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)).astype(np.int32)


def parts(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, dtype=np.int64)
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """An Arrow list for each numpy array, null for None."""
    sizes = [0 if a is None else len(a) for a in arrays]
    flat = np.concatenate([a for a in arrays if a is not None]) if any(sizes) else np.zeros(0)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(kind.to_pandas_dtype())), mask=pa.array([a is None for a in arrays]))


def table_of(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Rows whose members are scalars, bytes or numpy arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = [lists(list(c), f.type.value_type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())


def numpy_list(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray | None:
    value = batch.column(name)[i]
    return value.values.to_numpy() if value.is_valid else None


def slice_names(texts: DataFrame, tasks: int) -> DataFrame:
    """Each slice's distinct names, dealt by value: in order, without what the task says of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice(batch, i)
                s.cover()
                names = np.unique(s.names())
                task = task_of(names, tasks)
                low = names.astype(np.uint32).view(np.int32)
                rows = [(s.number, int(task[a]), low[a:b]) for a, b in parts(task)]
                if rows:
                    yield table_of(rows, NAMES)

    return texts.mapInArrow(run, NAMES)


def repeated_names(names: DataFrame, tasks: int) -> DataFrame:
    """Bits for a slice's names in one task: whether another slice has the name too, and whether HOT_SLICES have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        keys, task, low = [], [], []
        for batch in batches:
            keys += batch.column("slice").to_pylist()
            task += batch.column("task").to_pylist()
            low += [numpy_list(batch, "low", i) for i in range(batch.num_rows)]
        if not keys:
            return
        sizes = np.array([len(x) for x in low])
        name = np.repeat(np.array(task, dtype=np.int64), sizes) << 32 | np.concatenate(low).view(np.uint32).astype(np.int64)
        order = np.argsort(name, kind="stable")
        ordered = name[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(np.flatnonzero(new), len(ordered)))[np.cumsum(new) - 1]
        again, hot = np.zeros(len(name), dtype=bool), np.zeros(len(name), dtype=bool)
        again[order], hot[order] = count > 1, count >= HOT_SLICES
        end = np.cumsum(sizes)
        rows = [(k, t, np.packbits(again[b - n : b]).tobytes(), np.packbits(hot[b - n : b]).tobytes()) for k, t, n, b in zip(keys, task, sizes.tolist(), end.tolist(), strict=True) if again[b - n : b].any()]
        if rows:
            yield table_of(rows, FLAGS)

    return names.repartitionById(tasks, "task").mapInArrow(run, FLAGS)


def triples(texts: DataFrame, flags: DataFrame, tasks: int) -> DataFrame:
    """Triples of the names that are left. Of equal ones in a slice only the first is dealt to a task; the others repeat, and come with a null task."""
    flagged = flags.groupBy("slice").agg(F.collect_list(F.struct("task", "again", "hot")).alias("flags"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        from xxhash import xxh64_intdigest

        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice(batch, i)
                s.cover()
                h = s.names()
                names, which, count = np.unique(h, return_inverse=True, return_counts=True)
                again, hot = count > 1, np.zeros(len(names), dtype=bool)
                task = task_of(names, tasks)
                ranges = {int(task[a]): (a, b) for a, b in parts(task)}
                for f in batch.column("flags")[i].as_py() or ():
                    a, b = ranges[f["task"]]
                    again[a:b] |= np.unpackbits(np.frombuffer(f["again"], dtype=np.uint8), count=b - a).astype(bool)
                    hot[a:b] |= np.unpackbits(np.frombuffer(f["hot"], dtype=np.uint8), count=b - a).astype(bool)
                left = np.flatnonzero(again[which])
                if not len(left):
                    continue
                at, low, high = s.flat[left], s.low[left], s.high[left]
                around = np.array([xxh64_intdigest(s.text[a:b], k) for a, b, k in zip((at - low).tolist(), (at + high).tolist(), low.tolist(), strict=True)], dtype=np.uint64)
                # of equal triples the first place goes on; places are in order already
                order = np.lexsort((around, h[left]))
                g, w = h[left][order], around[order]
                same = np.concatenate(([False], (g[1:] == g[:-1]) & (w[1:] == w[:-1])))
                rows = [(s.number, None, None, None, None, None, np.sort(left[order[same]]))] if same.any() else []
                first = np.sort(order[~same])
                left, around, crowded = left[first], around[first], hot[which[left[first]]]
                row = s.rows[s.doc[left]]
                for kind in (False, True):
                    some = np.flatnonzero(crowded == kind)
                    task = task_of(around[some] if kind else h[left[some]], tasks)
                    dealt = some[np.argsort(task, kind="stable")]
                    task.sort()
                    for a, b in parts(task):
                        mine = dealt[a:b]
                        name = h[left[mine]]
                        rows.append((s.number, int(task[a]), None if kind else name.astype(np.uint32).view(np.int32), name.view(np.int64) if kind else None, around[mine].view(np.int64), np.diff(row[mine], prepend=0), left[mine]))
                yield table_of(rows, TRIPLES)

    return texts.join(flagged, "slice", "left").select("slice", "rows", "sizes", "z", "flags").mapInArrow(run, TRIPLES)


def sorted_triples(dealt: DataFrame, tasks: int) -> DataFrame:
    """Repeats and open places, by slice and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                row, place = np.cumsum(numpy_list(batch, "row", i)), numpy_list(batch, "place", i)
                low, whole = numpy_list(batch, "low", i), numpy_list(batch, "whole", i)
                # whole names are told from the others by their sign
                gram = (np.int64(batch.column("task")[i].as_py()) << 32 | low.view(np.uint32).astype(np.int64)) if whole is None else whole | np.int64(-1 << 63)
                held.append((np.full(len(place), batch.column("slice")[i].as_py()), gram, numpy_list(batch, "around", i), row, place))
        if not held:
            return
        number, gram, around, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        like = g[1:] == g[:-1]
        several = (np.append(like, False) | np.append(False, like)) | (g < 0)
        order = order[several]
        order = order[np.lexsort((place[order], row[order], around[order], gram[order]))]
        number, gram, around, row, place = (c[order] for c in (number, gram, around, row, place))
        if not len(gram):
            return
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new = new_gram | np.append(True, around[1:] != around[:-1])
        # a name of one triple has no open place, unless its other triples may be elsewhere
        classes = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
        free = new & ((classes > 1) | (gram < 0))
        kind = np.where(gram < 0, SPREAD, np.where(classes > GRAM_CLASSES, HEAVY, LIGHT))
        rows = []
        for wanted in (LIGHT, HEAVY, SPREAD):
            kept = np.flatnonzero((free | ~new) & (kind == wanted))
            kept = kept[np.argsort(number[kept], kind="stable")]
            for a, b in parts(number[kept]):
                mine = kept[a:b]
                is_open = mine[free[mine]]
                rows.append((int(number[mine[0]]), wanted, place[mine[~free[mine]]], place[is_open], gram[is_open]))
        if rows:
            yield table_of(rows, FOUND)

    known = dealt.where("task IS NULL").select("slice", F.lit(LIGHT).alias("kind"), F.col("place").alias("again"), F.array().cast("array<int>").alias("open"), F.array().cast("array<bigint>").alias("gram"))
    return dealt.where("task IS NOT NULL").repartitionById(tasks, "task").mapInArrow(run, FOUND).union(known)


def surroundings(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes around each open place of (slice, open, gram)."""
    wanted = places.groupBy("slice").agg(F.flatten(F.collect_list("open")).alias("open"), F.flatten(F.collect_list("gram")).alias("gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice(batch, i)
                s.cover(numpy_list(batch, "open", i))
                gram, low, row, at = numpy_list(batch, "gram", i), s.low.astype(np.int16), s.rows[s.doc], s.at.astype(np.int32)
                a, b = s.flat - s.low, s.flat + s.high
                for k in range(0, len(gram), 20_000):
                    to = slice(k, k + 20_000)
                    cut = [s.text[x:y] for x, y in zip(a[to].tolist(), b[to].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(gram[to]), pa.array(np.full(len(cut), s.number)), pa.array(row[to]), pa.array(at[to]), pa.array(low[to]), pa.array(cut, pa.binary())], names=AROUND.fieldNames())

    return texts.join(wanted, "slice").select("slice", "rows", "sizes", "z", "open", "gram").mapInArrow(run, AROUND)


def padded_rows(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width)


def prefix_names(rows: np.ndarray, lengths: np.ndarray, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and how many bytes each has in common with the one before (-1 where ``top`` differs)."""
    width = -(-rows.shape[1] // 8) * 8
    words = np.zeros((len(rows), width), dtype=np.uint8)
    words[:, : rows.shape[1]] = rows
    keys = words.view(">u8").astype(np.uint64)
    # rows that only NUL bytes tell apart: short ones first, so that equal ones are neighbours
    order = np.lexsort([lengths] + [keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)] + ([top] if top is not None else []))
    a, b = rows[order[1:]], rows[order[:-1]]
    unlike = a != b
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    if top is not None:
        common[top[order[1:]] != top[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def merge_group(gram: np.ndarray, row: np.ndarray, at: np.ndarray, low: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (which, start, stop) of the strings around these places that have an equal string at an earlier place here.

    Places come with their whole surroundings, and all open ones of a name are among them.
    """
    n = len(row)
    if n < 2:
        return np.zeros(0, dtype=np.int64), at[:0], at[:0]
    # earlier places have smaller numbers
    place = np.lexsort((at, row))
    gram, row, at, low = gram[place], row[place], at[place], low[place].astype(np.int64)
    around = [around[i] for i in place.tolist()]
    right = [x[k:] for x, k in zip(around, low.tolist(), strict=True)]
    left = [x[:k][::-1] for x, k in zip(around, low.tolist(), strict=True)]
    high = np.array([len(x) for x in right], dtype=np.int64)
    r_order, r_common = prefix_names(padded_rows(right, LENGTH), high, gram)
    l_order, l_common = prefix_names(padded_rows(left, BEFORE), low)
    found = np.zeros((n, BEFORE + 1), dtype=bool)
    name_r, name_l = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for back in range(BEFORE + 1):
        # equal names: the same LENGTH - back bytes from the sample on, the same ``back`` bytes before it
        name_r[r_order] = np.cumsum(r_common < LENGTH - back)
        name_l[l_order] = np.cumsum(l_common < back)
        fit = np.flatnonzero((low >= back) & (high >= LENGTH - back))
        key = name_r[fit] * (n + 1) + name_l[fit]
        order = np.argsort(key, kind="stable")
        key = key[order]
        again = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.zeros(0, dtype=bool)
        found[fit[order[again]], back] = True
    # runs of strings: from back = a to b they cover at - b to at - a + LENGTH
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1] - 1
    return place[who], at[who] - b, at[who] - a + LENGTH


def merged(around: DataFrame, tasks: int) -> DataFrame:
    """Spans of the strings around open places that repeat, by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        held: list[pa.RecordBatch] = []
        count = 0

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            got = [table.column(n).to_numpy() for n in ("gram", "row", "at", "low")]
            which, start, stop = merge_group(*got, table.column("bytes").to_pylist())
            number, row = table.column("slice").to_numpy()[which], got[1][which]
            order = np.argsort(number, kind="stable")
            number, row, start, stop = (c[order] for c in (number, row, start, stop))
            rows = [(int(number[a]), row[a:b], start[a:b], stop[a:b]) for a, b in parts(number)]
            if rows:
                yield table_of(rows, SPANS)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= TASK_CLASSES:
                # whole names only: the last one may go on
                table = pa.Table.from_batches(held)
                gram = table.column("gram").to_numpy()
                cut = int(np.flatnonzero(gram == gram[-1])[0])
                if cut:
                    yield from solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                count = sum(b.num_rows for b in held)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return around.repartition(tasks, "gram").sortWithinPartitions("gram").mapInArrow(run, SPANS)


def dealt_strings(around: DataFrame) -> DataFrame:
    """Spans of repeated strings, each string dealt by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for part in pieces(batches, 2000):
            row, start, keys, number = [], [], [], []
            for r, at, low, data, k in zip(*(part.column(n).to_pylist() for n in ("row", "at", "low", "bytes", "slice")), strict=True):
                for i in range(len(data) - LENGTH + 1):
                    keys.append(hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest())
                    row.append(r)
                    start.append(at - low + i)
                    number.append(k)
            key = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(number, pa.int64())], names=STRING.fieldNames())

    strings = around.mapInArrow(run, STRING)
    first = strings.groupBy("k1", "k2").agg(F.min(F.struct("row", "start")).alias("first"))
    late = strings.join(first.hint("merge"), ["k1", "k2"]).where(F.struct("row", "start") != F.col("first"))
    return late.select("slice", F.array("row").alias("row"), F.array("start").alias("start"), F.array((F.col("start") + LENGTH).cast("int")).alias("stop"))


def repeats(texts: DataFrame, n_bytes: int) -> DataFrame:
    """Of each slice, the covered positions that repeat (``again``) and spans of other repeated strings: the union of all is what goes."""
    with small_batches(texts.sparkSession):
        return stored_repeats(texts, n_bytes)


def stored_repeats(texts: DataFrame, n_bytes: int) -> DataFrame:
    spark = texts.sparkSession
    tasks = max(2 * partitions(spark), n_bytes // NAMED_BYTES + 1)
    flags = written(repeated_names(slice_names(texts, tasks), tasks), "names")
    found = written(sorted_triples(triples(texts, flags, tasks), tasks), "triples")
    drop(spark, stored_at(flags))
    light = found.where(F.col("kind") == LIGHT).select("slice", "open", "gram")
    heavy = found.where(F.col("kind") == HEAVY).select("slice", "open", "gram")
    spread = found.where((F.col("kind") == SPREAD) & (F.size("open") > 0)).select("slice", F.explode(F.arrays_zip("open", "gram")).alias("p")).select("slice", F.array("p.open").alias("open"), F.array("p.gram").alias("gram"), F.col("p.gram").alias("name"))
    if not spread.isEmpty():
        counts = written(spread.groupBy("name").agg(F.count("*").alias("n")), "counts")
        sized = spread.join(counts.hint("merge"), "name")
        light = light.union(sized.where(F.col("n") <= GRAM_CLASSES).select("slice", "open", "gram"))
        heavy = heavy.union(sized.where(F.col("n") > GRAM_CLASSES).select("slice", "open", "gram"))
    n_open = light.agg(F.sum(F.size("open"))).first()[0] or 0
    spans = written(merged(surroundings(texts, light), max(partitions(spark), n_open // TASK_CLASSES + 1)), "merged")
    if not heavy.where(F.size("open") > 0).isEmpty():
        spans = spans.union(written(dealt_strings(written(surroundings(texts, heavy), "around")), "strings"))
    return found.where(F.size("again") > 0).select("slice", "again").unionByName(spans, allowMissingColumns=True)


def cleaned(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): each text without what goes."""
    gathered = gone.groupBy("slice").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("again", "row", "start", "stop")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice(batch, i)
                again = numpy_list(batch, "again", i)
                removed = runs = np.zeros(len(s.rows), dtype=np.int64)
                kept = [s.text[a : a + n] for a, n in zip(s.begin.tolist(), s.sizes.tolist(), strict=True)]
                if again is not None:
                    s.cover(again)
                    row, start, stop = (numpy_list(batch, n, i) for n in ("row", "start", "stop"))
                    begin = s.begin[np.searchsorted(s.rows, row)]
                    change = np.zeros(len(s.text) + 1, dtype=np.int32)
                    for at, by in ((s.flat - s.low, 1), (s.flat + s.high, -1), (begin + start, 1), (begin + stop, -1)):
                        np.add.at(change, at, by)
                    cut = np.cumsum(change[:-1]) > 0
                    before = np.concatenate(([0], np.cumsum(cut)))
                    head = cut & ~np.concatenate(([False], cut[:-1]))
                    some = np.minimum(s.begin, max(0, len(cut) - 1))
                    head[some[s.sizes > 0]] = cut[some[s.sizes > 0]]
                    heads = np.concatenate(([0], np.cumsum(head)))
                    end = s.begin + s.sizes
                    removed, runs = before[end] - before[s.begin], heads[end] - heads[s.begin]
                    text = np.frombuffer(s.text, dtype=np.uint8)
                    for d in np.flatnonzero(removed).tolist():
                        a, b = int(s.begin[d]), int(end[d])
                        kept[d] = text[a:b][~cut[a:b]].tobytes()
                for a in range(0, len(kept), 2000):
                    to = slice(a, a + 2000)
                    yield pa.RecordBatch.from_arrays([pa.array(s.rows[to]), pa.array(s.sizes[to]), pa.array(removed[to]), pa.array(runs[to]), pa.array(kept[to], pa.binary())], names=CLEANED.fieldNames())

    return texts.join(gathered, "slice", "left").mapInArrow(run, CLEANED)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row: its UTF-8 bytes without those that a repeat covers.

    A byte goes if a 100-byte string that holds it also starts earlier: in a row of smaller id, or earlier in the
    same row. Strings are those of the input and lie within one row; a null text is empty. Of rows with equal ids,
    one (by a hash of the text) counts as the earlier; rows with null ids come last. ``kept`` may end a
    multi-byte character early. An empty table gives no rows.
    """
    rows, by_id = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows = rows.withColumnRenamed(ROW, "row")
    texts = written(slices(rows), "slices")
    n_bytes = texts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    out = cleaned(texts, repeats(texts, n_bytes))
    if by_id:
        return out.withColumnRenamed("row", "doc_id")
    return out.join(rows.select("row", "doc_id").hint("merge"), "row").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each text cut as remove_repeats() says, and its new length in ``chars_col``; a character that loses a byte goes. A null text becomes empty."""
    # the other columns travel by themselves: the text that comes back is another one
    others = F.struct(*[c for c in docs.columns if c != text_col]) if len(docs.columns) > 1 else F.lit(None)
    rows, _ = numbered(docs.select(others.alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    before = scratch_paths()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()], pa.string())], names=[ROW, "_kept"])

    # stored, so that the tables behind it can go before the rows are put together
    with small_batches(docs.sparkSession):
        texts = written(remove_repeats(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), "kept").mapInArrow(decode, f"{ROW} long, _kept string"), "cut-texts")
    sweep(docs.sparkSession, [*before, stored_at(texts)])
    new = {text_col: F.col("_kept")}
    if chars_col in docs.columns:
        new[chars_col] = F.length("_kept").cast(docs.schema[chars_col].dataType)
    return rows.select(ROW, "doc").join(texts, ROW).select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def digests(cleaned_rows: DataFrame) -> DataFrame:
    return cleaned_rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

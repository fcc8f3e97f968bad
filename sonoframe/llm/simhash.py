"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a variant in common that lies within half the
radius of both, and any two fingerprints that share such a variant link. Every fingerprint emits its ball of
variants in two steps: the shuffled rows carry the variant's value on ``k`` chosen bits (one row for each way
to spend flips on them), and the task that gets all rows of such a value completes the variants on the other
bits, sorts them and links those that collide. This emits each variant once and shuffles 1 + k + k(k-1)/2 rows
a fingerprint in place of 2,081. A value that gathers more variants than a task should hold is split by more
bits, as often as it takes, so no group is dropped or cut.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.common import ROW, numbered, pieces, vacate, wrapped, written
from sonoframe.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Variants that a task holds at once for one group; larger groups are split by more bits.
GROUP_VARIANTS = 3_000_000
#: Bits that a split adds.
STEP = 6
LEAST_BITS = 9

FINGERPRINT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
EMITTED = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("left", T.ByteType())])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of each bit over the XXH64 of all word shingles; no words give zero, a few words one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in pieces(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FINGERPRINT)


def mask(bits) -> int:
    return sum(1 << int(b) for b in bits)


def flips(bits, most: int) -> list[tuple[int, int]]:
    """(flips, their number) for each choice of at most ``most`` of ``bits``."""
    return [(mask(c), n) for n in range(most + 1) for c in itertools.combinations(bits, n)]


def emit(rows: DataFrame, old: list[int], new: list[int], half: int) -> DataFrame:
    """Rows (key, fp, left) for each value on old and new bits that a variant can have; ``left`` flips remain for other bits."""
    choices = flips(new, half)
    change, spent = np.array([c for c, _ in choices], dtype=np.uint64), np.array([n for _, n in choices], dtype=np.int8)
    held, added = np.uint64(mask(old)), np.uint64(mask(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                key, fp, left = (batch.column(i).slice(at, 20_000).to_numpy(zero_copy_only=False) for i in range(3))
                fp = fp.view(np.uint64)
                key = (key.view(np.uint64) & held) | (fp & added)
                who, which = np.nonzero(spent[None, :] <= left[:, None])
                yield pa.RecordBatch.from_arrays([pa.array((key[who] ^ change[which]).view(np.int64)), pa.array(fp[who].view(np.int64)), pa.array(left[who] - spent[which])], schema=pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("left", pa.int8())]))

    return rows.mapInArrow(run, EMITTED)


def join_ball(fp: np.ndarray, key: np.ndarray, left: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) of fingerprints that share a variant: complete the variants, sort them, join what collides."""
    known = np.uint64(mask(bits))
    base = (fp & ~known) | key
    rest = [b for b in range(64) if b not in set(bits)]
    variants, owners = [], []
    for n in range(radius // 2 + 1):
        change = np.array([mask(c) for c in itertools.combinations(rest, n)], dtype=np.uint64)
        who = np.flatnonzero(left >= n).astype(np.int32)
        if len(who) and len(change):
            variants.append((base[who][:, None] ^ change[None, :]).reshape(-1))
            owners.append(np.repeat(who, len(change)))
    ordered = np.concatenate(variants)
    ordered.sort()
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return fp[:0], fp[:0]
    hits = []
    for value, owner in zip(variants, owners, strict=True):
        for at in range(0, len(value), 1 << 18):
            place = np.searchsorted(twice, value[at : at + (1 << 18)])
            hit = twice[np.minimum(place, len(twice) - 1)] == value[at : at + (1 << 18)]
            hits.append((place[hit], owner[at : at + (1 << 18)][hit]))
    del variants, owners
    place, owner = (np.concatenate(c) for c in zip(*hits, strict=True))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    lead = np.repeat(owner[first], np.diff(np.append(first, len(place))))
    close = np.bitwise_count(fp[owner] ^ fp[lead]) <= radius
    owner, lead = owner[close], lead[close]
    label = np.arange(len(fp))
    while True:
        least = np.minimum(label[owner], label[lead])
        after = label.copy()
        np.minimum.at(after, owner, least)
        np.minimum.at(after, lead, least)
        np.minimum.at(after, label[owner], least)
        np.minimum.at(after, label[lead], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(fp != fp[label])
    return fp[moved], fp[label[moved]]


def solver(bits: list[int], radius: int):
    def solve(group):
        key, fp, left = (group.column(name).to_numpy() for name in ("key", "fp", "left"))
        a, b = join_ball(fp.view(np.uint64), key.view(np.uint64), left, bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return solve


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that connect all fingerprints within ``radius`` bits of one another; ``fps`` has distinct ``fp``."""
    half = radius // 2
    # the most even bits first, so that their values divide the fingerprints evenly
    tally = fps.agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]).first()
    n = tally["n"]
    order = sorted(range(64), key=lambda b: (abs(2 * (tally[f"b{b}"] or 0) - n), b))
    ball = sum(math.comb(64, i) for i in range(half + 1))
    k = min(40, max(LEAST_BITS, math.ceil(math.log2(max(1, n * ball / (GROUP_VARIANTS / 4))))))
    links, bits = [], order[:k]
    pending = emit(fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(half).cast("byte").alias("left")), [], bits, half)
    while True:
        rest = 64 - len(bits)
        weight = sum(F.when(F.col("left") >= i, math.comb(rest, i)).otherwise(0) for i in range(half + 1))
        heavy = written(pending.groupBy("key").agg(F.sum(weight).alias("w")).where(F.col("w") > GROUP_VARIANTS).select("key"), "heavy") if rest else None
        crowded = heavy is not None and not heavy.isEmpty()
        small = pending.join(heavy, "key", "left_anti") if crowded else pending

        links.append(small.groupBy("key").applyInArrow(solver(bits, radius), LINK))
        if not crowded:
            break
        more = order[len(bits) : len(bits) + STEP]
        pending = emit(pending.join(heavy, "key", "left_semi").select("key", "fp", "left"), bits, more, half)
        bits = bits + more
    found = links[0]
    for other in links[1:]:
        found = found.union(other)
    return found.distinct()


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: fingerprints within ``radius`` bits link.

    Null and empty texts have fingerprint zero and link like any other. component_id is the least id that
    links reach, itself included; rows with a null id keep it and are in the component of their fingerprint.
    Repeated rows stay. An empty table gives no rows.
    """
    each = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    nodes = components(ball_links(fps.select("fp"), radius))
    label = fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    label = written(label, "labels")
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = written(label.join(least, "component").select("fp", "component_id"), "known")
    return each.join(known.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the first row, by id, of each component of near duplicates.

    Of rows with equal ids, one (by a hash of the text) counts as the first; rows with null ids come last. Null and
    empty texts are duplicates of one another. Any further columns stay as they are.
    """
    rows, _ = numbered(wrapped(docs, doc_id=F.col(id_col), text=F.col(text_col)))
    found = near_duplicates(rows, radius=radius, id_col=ROW)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(ROW))
    return rows.join(kept.hint("merge"), ROW, "left_semi").select("doc.*")

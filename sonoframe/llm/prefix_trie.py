"""The prefix trie of conversations, from a mergesort that knows how much neighbours share.

A conversation is a row of turn keys, 16 bytes of a hash of role and text. Tasks sort runs of such rows; a run
carries, with each conversation, how many turns it shares with the one before (its LCP), and stores only the others.
Runs are cut at sampled bounds of sequence and id, so a range gets blocks of many runs and no sequence, however
frequent, has to lie in one range. A range merges its runs with a loser tree: a conversation that shares more turns
with the last one put out comes first, and only where that is equal are turns compared, from there on. Blocks are
sorted by the conversation after which they are needed, so a task holds one block a run.

The merged stream meets a trie's nodes in order; a stack holds the open path, and a node is put out when the stream
leaves it. What a node sums over its subtree are sums over neighbours in order: the turns that a conversation shares
with the one before are saved, and one that the next one doesn't continue ends a leaf. So nodes that a bound cuts are
put together by adding their parts.

A conversation's keys are held by one task: 20 bytes a turn. Rows without conv_id are no conversation's. Turns with
equal ``turn`` come in order of their hash, repeated ones as often as they are there.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import WORD, partitions, pieces, written

#: Bytes of a turn's key.
KEY = 16
#: The branching that the contract fixes: conversations begin like the first of so many, for up to so many turns.
FAMILY, HEADS = 20, 4
#: Bytes of a run and of a range, and what a conversation counts for besides its keys.
RUN_BYTES, RANGE_BYTES, ROW_BYTES = 16 << 20, 32 << 20, 64
BLOCK_ROWS, BLOCK_BYTES = 500, 256 << 10
#: Rows sampled a range, and bytes of a sequence that a bound keeps.
SAMPLED, BOUND_BYTES = 30, 1024
LEAST_ID = -(1 << 63)
BLOCK = "range int, need binary, need_id long, first binary, first_id long, last binary, last_id long, ids array<long>, sizes array<int>, lcps array<int>, keys binary, words array<int>"
PART = "range int, no long, depth int, conv_id long, n long, children long, leaves long, shared long, base long, ends_sha256 string, key binary, ids string"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_key(role: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): keys and words of each conversation's turns in order, null ``turn`` first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(WORD))
    one = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").cast("long").alias("turn"), turn_key(role, text).alias("key"), words.alias("words"))
    held = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return held.select("conv_id", F.transform("ts", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def branched(seqs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, turns) with each conversation's first turns replaced by those of the first of its family, as many as a hash of its id says."""
    base = F.col("conv_id") - F.col("conv_id") % family
    firsts = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    nothing = F.slice("turns", 1, 0)
    own = F.slice(F.col("turns"), h + 1, F.size("turns"))
    return seqs.withColumn("base", base).join(firsts, "base", "left").select("conv_id", F.concat(F.when(h > 0, F.slice(F.coalesce("head", nothing), F.lit(1), h)).otherwise(nothing), own).alias("turns"))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences share at the start, of which ``known`` are known."""
    low, high = known, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * KEY : mid * KEY] == b[low * KEY : mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


def bounds(rows: DataFrame) -> list[tuple[bytes, int]]:
    """Where ranges begin, but for the first: sampled (sequence, id), as many as ``rows`` (conv_id, seq, words) needs."""
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("seq") + ROW_BYTES)).first()
    ranges = max(min(partitions(rows.sparkSession), n), -(-(size or 0) // RANGE_BYTES))
    if ranges < 2:
        return []
    part = rows.sample(fraction=min(1.0, SAMPLED * ranges / n), seed=1).select(F.substring("seq", 1, BOUND_BYTES).alias("seq"), F.when(F.octet_length("seq") <= BOUND_BYTES, F.col("conv_id")).otherwise(F.lit(LEAST_ID)).alias("id"))
    found = sorted((bytes(r["seq"]), r["id"]) for r in part.collect())  # at most a few dozen rows a range
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


BLOCK_TYPES = [pa.int32(), *[pa.binary(), pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32())]
BLOCK_NAMES = ["range", "need", "need_id", "first", "first_id", "last", "last_id", "ids", "sizes", "lcps", "keys", "words"]


def block_of(place: int, need: tuple, ends: tuple, rows: list[tuple]) -> pa.RecordBatch:
    ids, lcps, keys, words, sizes = [], [], [], [], []
    before = need[0] or b""
    for seq, key, ws in rows:
        lcp = common(before, seq)
        ids.append(key)
        sizes.append(len(ws))
        lcps.append(lcp)
        keys.append(seq[lcp * KEY :])
        words += ws[lcp:]
        before = seq
    return pa.record_batch([pa.array([v], k) for v, k in zip([place, *need, *ends, ids, sizes, lcps, b"".join(keys), words], BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)


def run_blocks(held: list[tuple[bytes, int, list[int]]], cuts: list[tuple[bytes, int]], most: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """A run of (sequence, id, words), sorted, cut at the bounds and into blocks."""
    held.sort(key=lambda r: r[:2])
    i = 0
    while i < len(held):
        place = bisect.bisect_right(cuts, held[i][:2])
        j = bisect.bisect_left(held, cuts[place], i, key=lambda r: r[:2]) if place < len(cuts) else len(held)
        need, ends = (None, None), (*held[i][:2], *held[j - 1][:2])
        while i < j:
            k, size = i, 0
            while k < j and k - i < most and size < BLOCK_BYTES:
                size += len(held[k][0])
                k += 1
            yield block_of(place, need, ends, held[i:k])
            need, ends, i = held[k - 1][:2], (None,) * 4, k


def sorted_runs(rows: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    """Blocks of sorted runs. ``need`` is what comes before the block in its run and range; the first one has none, and tells the ends of that part of the run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches):
            for key, seq, words in zip(*(batch[c].to_pylist() for c in ("conv_id", "seq", "words")), strict=True):
                held.append((seq, key, words))
                size += len(seq) + ROW_BYTES
                if size >= RUN_BYTES:
                    yield from run_blocks(held, cuts)
                    held, size = [], 0
        if held:
            yield from run_blocks(held, cuts)

    return rows.mapInArrow(runs, BLOCK)


class Run:
    """A run's place in a merge: its conversation at hand, and how many turns that shares with the last one put out."""

    __slots__ = ("block", "id", "key_at", "lcp", "pos", "seq", "word_at", "words")

    def __init__(self, block: dict):
        self.seq, self.words = b"", []
        self.take(block)

    def take(self, block: dict) -> None:
        self.block, self.pos, self.key_at, self.word_at = block, -1, 0, 0
        self.advance()

    def advance(self) -> bool:
        """The next conversation of the block, if it has one; the last one put out is then the one before it."""
        self.pos += 1
        b = self.block
        if self.pos == len(b["ids"]):
            return False
        self.id, self.lcp = b["ids"][self.pos], b["lcps"][self.pos]
        new = b["sizes"][self.pos] - self.lcp
        self.seq = self.seq[: self.lcp * KEY] + b["keys"][self.key_at : self.key_at + new * KEY]
        self.words = self.words[: self.lcp] + b["words"][self.word_at : self.word_at + new]
        self.key_at, self.word_at = self.key_at + new * KEY, self.word_at + new
        return True


def first_of(a: Run | None, b: Run | None) -> bool:
    """Whether ``a`` comes before ``b``; the other one then knows what it shares with the one that does."""
    if a is None or b is None:
        return b is None
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    shared = common(a.seq, b.seq, a.lcp)
    at, to = shared * KEY, shared * KEY + KEY
    ahead = (a.seq[at:to], a.id) < (b.seq[at:to], b.id)
    (b if ahead else a).lcp = shared
    return ahead


def merged(blocks: Iterator[dict]) -> Iterator[tuple[int, bytes, list[int], int]]:
    """(id, sequence, words, turns shared with the one before) in order, from a range's blocks in order of need."""
    waiting = next(blocks, None)
    runs: list[Run | None] = []
    while waiting is not None and waiting["need"] is None:
        runs.append(Run(waiting))
        waiting = next(blocks, None)
    k = len(runs)
    if not k:
        return
    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        won = first_of(runs[a], runs[b])
        losers[node] = b if won else a
        return a if won else b

    best = play(1) if k > 1 else 0
    while runs[best] is not None:
        run = runs[best]
        yield run.id, run.seq, run.words, run.lcp
        last = run.id
        if not run.advance():
            # ids are distinct, so the block that waits for this one is of the same run
            if waiting is not None and waiting["need_id"] == last:
                run.take(waiting)
                waiting = next(blocks, None)
            else:
                runs[best] = None
        node = (best + k) // 2
        while node >= 1:
            if first_of(runs[losers[node]], runs[best]):
                losers[node], best = best, losers[node]
            node //= 2


def prefix_keys(seq: bytes, upto: int) -> list[bytes]:
    """Hashes of the first 0 to ``upto`` turns."""
    h, out = hashlib.sha256(), []
    for d in range(upto + 1):
        h.update(seq[(d - 1) * KEY : d * KEY] if d else b"")
        out.append(h.copy().digest())
    return out


class Open:
    """A node of the path at hand. ``shared`` sums the words that its conversations share with the ones before them, ``base`` is the words before its own turn."""

    __slots__ = ("base", "children", "depth", "ids", "key", "leaves", "least", "n", "no", "extended", "shared")

    def __init__(self, no: int, depth: int, base: int, key: bytes | None):
        self.no, self.depth, self.base, self.key = no, depth, base, key
        self.n = self.children = self.leaves = self.shared = 0
        self.least, self.ids, self.extended = None, [], False


def nodes_of(stream: Iterator[tuple], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Rows of PART but for the range: nodes of a range's stream, between the last sequence before it and the first after it."""
    path: list[Open] = []
    no, seq = 0, b""

    def close(right: int = -1, keys: list[bytes] | None = None) -> tuple:
        node = path.pop()
        onward = node.depth <= right
        key = node.key or (keys[node.depth] if onward else None)
        if not node.extended and not onward:
            node.leaves += 1
        text = ",".join(map(str, node.ids))
        if path:
            up = path[-1]
            up.n, up.leaves, up.shared = up.n + node.n, up.leaves + node.leaves, up.shared + node.shared
            up.least = node.least if up.least is None or node.least < up.least else up.least
        whole = None if key else hashlib.sha256(text.encode()).hexdigest()
        return node.no, node.depth, node.least, node.n, node.children, node.leaves, node.shared, node.base, whole, key, text if key and node.ids else None

    for key, new, words, lcp in stream:
        first = not path
        left = -1
        if first:
            left = lcp = -1 if before is None else common(before, new)
            keys = prefix_keys(new, left)
        else:
            while len(path) - 1 > lcp:
                yield close()
            path[-1].shared += sum(words[:lcp])
        upto = sum(words[: max(0, len(path) - 1)])
        for d in range(len(path), len(new) // KEY + 1):
            if path:
                path[-1].extended = True
                path[-1].children += d > left
            # the root has no turn; a node's base leaves out its own
            path.append(Open(no, d, upto, keys[d] if d <= left else None))
            no += 1
            upto += words[d - 1] if d else 0
        if first and left >= 0:
            path[left].shared += sum(words[:left])
        top, seq = path[-1], new
        top.n += 1
        top.ids.append(key)
        top.least = key if top.least is None or key < top.least else top.least
    if path:
        right = -1 if after is None else common(seq, after)
        keys = prefix_keys(seq, right)
        while path:
            yield close(right, keys)


PART_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.string()]
PART_NAMES = ["range", "no", "depth", "conv_id", "n", "children", "leaves", "shared", "base", "ends_sha256", "key", "ids"]
#: Rows of an Arrow batch that a task puts out.
OUT_ROWS = 20_000


def parts(blocks: DataFrame, ranges: int) -> DataFrame:
    """Rows of PART from stored blocks: whole nodes, and with a ``key`` the parts of those that bounds cut."""
    ends = blocks.where(F.col("first").isNotNull()).groupBy("range").agg(F.min(F.struct("first", "first_id")).alias("f"), F.max(F.struct("last", "last_id")).alias("l"))
    # a row a range
    order = Window.orderBy("range")
    beside = ends.select("range", F.lag("l.last").over(order).alias("before"), F.lead("f.first").over(order).alias("after"))
    block = ("need", "need_id", "ids", "sizes", "lcps", "keys", "words")
    rows = blocks.select("range", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("after"), *block)
    rows = rows.unionByName(beside.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = rows.repartition(ranges, "range").sortWithinPartitions("range", "kind", "need", "need_id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, of_range in itertools.groupby((row for batch in batches for row in dicts(batch)), key=lambda r: r["range"]):
            beside = next(of_range)
            out: list[tuple] = []
            for node in nodes_of(merged(of_range), beside["before"], beside["after"]):
                out.append((place, *node))
                if len(out) >= OUT_ROWS:
                    yield part_rows(out)
                    out = []
            if out:
                yield part_rows(out)

    return dealt.mapInArrow(merge, PART)


def dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, made one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def part_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PART_TYPES, strict=True)], names=PART_NAMES)


def under_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a range sorted by their number, each after its parent, with the parent's conversation; cut nodes only where they are to be told."""
    path: list[int] = []
    for batch in batches:
        parents, keep = [], []
        for depth, conv, told in zip(*(batch[c].to_pylist() for c in ("depth", "conv_id", "told")), strict=True):
            del path[depth:]
            if told:
                parents.append(path[-1] if path else None)
            path.append(conv)
            keep.append(told)
        kept = batch.filter(pa.array(keep, pa.bool_()))
        columns = [kept["conv_id"], kept["depth"].cast(pa.int64()), pa.array(parents, pa.int64()), *(kept[c] for c in ("n", "children", "leaves", "saved", "ends_sha256"))]
        yield pa.record_batch(columns, names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def trie(seqs: DataFrame) -> DataFrame:
    """NODE for each distinct sequence of first turns of ``seqs`` (conv_id, turns), whose ids are distinct; no rows for none."""
    rows = seqs.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("seq"), F.col("turns.words").cast("array<int>").alias("words"))
    rows = written(rows, "sequences")
    cuts = bounds(rows)
    ranges = len(cuts) + 1
    found = written(parts(written(sorted_runs(rows, cuts), "runs"), ranges), "trie-parts")
    cut = found.where(F.col("key").isNotNull())
    sums = cut.groupBy("key").agg(F.min("range").alias("home"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "shared")], F.max("base").alias("base"))
    ids = cut.where(F.col("ids").isNotNull()).select("key", "range", "ids").repartition("key").sortWithinPartitions("key", "range").select("key", "ids")
    ends = ids.mapInArrow(digest_rows, "key binary, ends_sha256 string")
    merged_ = sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    again = cut.select("range", "no", "depth", "key").join(merged_, "key").withColumn("told", F.col("range") == F.col("home"))
    columns = ["range", "no", "depth", "conv_id", "n", "children", "leaves", (F.col("shared") - (F.col("n") - 1) * F.col("base")).alias("saved"), "ends_sha256", "told"]
    every = found.where(F.col("key").isNull()).withColumn("told", F.lit(True)).select(*columns).unionByName(again.select(*columns))
    return every.repartition(ranges, "range").sortWithinPartitions("range", "no").mapInArrow(under_parents, NODE)


def conversation_trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of ``turns`` (conv_id, turn, role, text), branched as the contract says."""
    return trie(branched(sequences(turns), family, heads))


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows (key, range, ids) sorted by key and range: the hash runs along, so no group's ids are held."""
    now, h, any_ids = None, None, False
    for batch in batches:
        out: list[tuple] = []
        for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, h.hexdigest()))
                now, h, any_ids = key, hashlib.sha256(), False
            h.update((b"," if any_ids else b"") + ids.encode())
            any_ids = True
        yield pa.record_batch([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["key", "ends_sha256"])
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends_sha256"])

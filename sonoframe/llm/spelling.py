"""Spelling variants: words one edit apart, found as points of rectangles.

Words are points: their rank in order of their letters, and their rank in order of their letters from the back. What
differs from a word at one place shares what lies before the place and what lies after it, so it is a point in the
rectangle of the two intervals, and a wavelet tree over the ranks reports exactly those. Replaced letters are looked
for among words as long, inserted ones among words one longer; a deletion is an insertion seen from the other word.

Over the cluster, a word's places are cut into windows. Words that agree on all that lies outside a window form a
group, and two words one edit apart share the group of the one window that holds their edit; a task builds the tree
of many whole groups. A group that is too large has its window halved; words that agree on all but one place are at
most as many as there are letters, so this ends, and no group depends on how much data there is.

A word is any run of letters as letters() takes them, a byte each (the letters of Latin-1). Null texts hold none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import pieces, written

#: Letters after lower-casing, in Latin-1.
RUN = re.compile(rb"[a-z\xC0-\xFF]+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Every so many hashes, a run loses a letter; fixed by the contract.
DROPS = 97
#: A form is so many times as frequent as its variant.
FORM_TIMES = 2
#: Distinct words that a task counts at once, and bytes of a text that are matched at once.
HELD_WORDS, LONG_TEXT = 200_000, 1 << 20
#: Rows and letters of a group above which its window is halved; rows and bytes of the words that one tree is built of.
GROUP_ROWS, GROUP_LETTERS, TREE_ROWS, TREE_BYTES = 20_000, 8 << 20, 100_000, 8 << 20
#: Rectangles that are reported at once.
ASKED = 200_000
REPLACED, INSERTED = 0, 1
COUNTED = "word string, n long"
PAIR = "word string, near string, near_n long"
GROUP = ("size", "kind", "a", "b", "key")


def letters(text: str) -> bytes:
    """A byte for each code point, A to Z as a to z; what isn't Latin-1 is a question mark, which no run holds."""
    return text.encode("latin-1", "replace").lower()


def run_counts(text: str, salt: str) -> Iterator[tuple[bytes, int]]:
    """The words of a text with their counts: its runs, some of them short of a letter that a hash with ``salt`` picks."""
    data = letters(text)
    found = Counter(RUN.findall(data)) if len(data) < LONG_TEXT else Counter(m.group() for m in RUN.finditer(data))
    start = zlib.crc32(f"{salt}:".encode())
    for run, n in found.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DROPS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words with at least ``least`` occurrences in all texts. A null id is the empty text in the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in pieces(batches, 100):
            for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                for word, n in run_counts(text or "", key):
                    total[word] += n
            if len(total) >= HELD_WORDS:
                yield flush()
        if total:
            yield flush()

    keyed = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    return keyed.mapInArrow(count, COUNTED).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def grouped(words: DataFrame) -> DataFrame:
    """A row of GROUP, word and n for each word and window that it takes part in: two windows a kind, to begin with."""
    size = F.length("word")

    def halves(kind: int, length, places):
        cut = F.floor(places / 2).cast("int")
        return [F.struct(length.alias("size"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")) for a, b in ((F.lit(0), cut), (cut, places.cast("int")))]

    # letters to replace are at 0 to size - 1; gaps to insert into at 0 to size of the shorter word
    rows = [*halves(REPLACED, size, size), *halves(INSERTED, size, size + 1), *halves(INSERTED, size - 1, size)]
    return with_key(words.select("word", "n", F.explode(F.array(*rows)).alias("w")).select("word", "n", "w.*"))


def with_key(rows: DataFrame) -> DataFrame:
    """``key``: a hash of what lies outside the window [a, b); equal hashes of different words only put them into one group."""
    longer = F.length("word") - F.col("size")  # 1 where letters were inserted
    after = F.col("b") - F.when((F.col("kind") == INSERTED) & (longer == 0), 1).otherwise(0)
    return rows.withColumn("key", F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), after + 1, F.length("word"))))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """The same rows with windows halved until no group has more than ``most`` rows or GROUP_LETTERS letters, or its window is one place."""
    out = []
    while True:
        sized = rows.groupBy(*GROUP).agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("letters"))
        large = written(sized.where(((F.col("rows") > most) | (F.col("letters") > GROUP_LETTERS)) & (F.col("b") - F.col("a") > 1)).select(*GROUP), "large-groups")
        if large.isEmpty():
            break
        out.append(rows.join(large, list(GROUP), "left_anti").select(*GROUP, "word", "n"))
        cut = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a"), cut.alias("b")), F.struct(cut.alias("a"), F.col("b"))))
        split = rows.join(large, list(GROUP), "left_semi").select("word", "n", "size", "kind", halves.alias("h")).select("word", "n", "size", "kind", "h.a", "h.b")
        rows = written(with_key(split), "halved-groups")
    for part in out:
        rows = rows.unionByName(part)
    return rows


class Wavelet:
    """A permutation of 0 to n - 1, a bit of its values a level, highest first."""

    def __init__(self, values: np.ndarray):
        self.levels, v = [], values.astype(np.int64)
        for bit in reversed(range(max(1, int(len(v) - 1).bit_length()))):
            ones = (v >> bit) & 1
            self.levels.append((bit, len(v) - int(ones.sum()), np.concatenate(([0], np.cumsum(ones)))))
            v = np.concatenate((v[ones == 0], v[ones == 1]))

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which rectangle, value) for each value in [y1, y2) at a place in [x1, x2)."""
        asked, left, right, low = np.arange(len(x1)), x1, x2, np.zeros(len(x1), np.int64)
        for bit, zeros, ones in self.levels:
            o1, o2 = ones[left], ones[right]
            asked, low = np.concatenate((asked, asked)), np.concatenate((low, low + (1 << bit)))
            left, right = np.concatenate((left - o1, zeros + o1)), np.concatenate((right - o2, zeros + o2))
            keep = (left < right) & (low < y2[asked]) & (low + (1 << bit) > y1[asked])
            asked, left, right, low = asked[keep], left[keep], right[keep], low[keep]
        return asked, low


class Order:
    """Words of several groups in order of group and letters, with how far neighbours agree: -1 across groups."""

    def __init__(self, words: list[bytes], group: np.ndarray, points: np.ndarray):
        size = np.array([len(w) for w in words])
        texts = np.array(words, dtype=f"S{size.max()}")
        self.order = np.lexsort((texts, group))
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        grid = texts.view(np.uint8).reshape(len(words), -1)[self.order]
        same = grid[1:] == grid[:-1]
        agree = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) if same.size else np.zeros(0, np.int64)
        ends = size[self.order]
        agree = np.minimum(agree, np.minimum(ends[1:], ends[:-1]))
        agree[group[self.order][1:] != group[self.order][:-1]] = -1
        #: lcp[k] is of ranks k - 1 and k; both ends agree with nothing
        self.lcp = np.concatenate(([-1], agree, [-1]))
        #: how many points come before a rank
        self.before = np.concatenate(([0], np.cumsum(points[self.order])))
        self.least = [self.lcp]
        while 1 << len(self.least) <= len(self.lcp):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def shared(self) -> np.ndarray:
        """For each word, the most letters that it shares with another one of its group."""
        return np.maximum(self.lcp[self.rank], self.lcp[self.rank + 1])

    def interval(self, word: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points, by their number in order, that share ``depth`` letters with a word."""
        left, right = self.rank[word].copy(), self.rank[word].copy()
        for j in reversed(range(len(self.least))):
            table, step = self.least[j], 1 << j
            start = left - step + 1
            fits = start >= 0
            fits[fits] = table[start[fits]] >= depth[fits]
            left[fits] -= step
            fits = right + step < len(self.lcp)
            fits[fits] = table[right[fits] + 1] >= depth[fits]
            right[fits] += step
        return self.before[left], self.before[right + 1]


def near_in(words: list[bytes], group: np.ndarray, size: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking word, other word) one edit apart within their group's window, each of them once a direction: both for replaced letters, from the shorter word for inserted ones."""
    length = np.array([len(w) for w in words])
    inserted = kind == INSERTED
    points, asks = ~inserted | (length > size), length == size
    if not points.any() or not asks.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ahead, back = Order(words, group, points), Order([w[::-1] for w in words], group, points)
    # places of the window where both what is before and what is after is shared with some word
    most_after = np.where(inserted, size, size - 1)
    low, high = np.maximum(a, most_after - back.shared()), np.minimum(b - 1, ahead.shared())
    n = np.where(asks, np.maximum(high - low + 1, 0), 0)
    point_rows = ahead.order[points[ahead.order]]
    number = back.before[back.rank]  # of a point, from the back
    tree = Wavelet(number[point_rows])
    by_number = np.empty(len(point_rows), np.int64)
    by_number[number[point_rows]] = point_rows
    found = []
    askers = np.flatnonzero(n)
    upto = np.cumsum(n[askers])
    start = 0
    while start < len(askers):
        base = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, base + ASKED, "right")))
        part = askers[start:end]
        word = np.repeat(part, n[part])
        place = np.arange(len(word)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + low[word]
        x1, x2 = ahead.interval(word, place)
        y1, y2 = back.interval(word, most_after[word] - place)
        real = (x1 < x2) & (y1 < y2)
        word, place = word[real], place[real]
        asked, value = tree.report(x1[real], x2[real], y1[real], y2[real])
        one, other, at = word[asked], by_number[value], place[asked]
        # a word itself is no variant; a letter that repeats could be inserted at several places, the last of them counts
        keep = one != other
        for i in np.flatnonzero(keep & inserted[one]):
            short, long_, p = words[one[i]], words[other[i]], at[i]
            keep[i] = p == len(short) or short[p] != long_[p]
        found.append((one[keep], other[keep]))
        start = end
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_pairs(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n) that one inserted, deleted or replaced letter tells apart, in both directions, once each."""
    rows = bounded(grouped(words), group_rows)
    dealt = rows.select(*GROUP, "word", "n").repartition(*[F.col(c) for c in GROUP]).sortWithinPartitions(*GROUP)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches):
            words = [w.encode("latin-1") for w in held["word"]]
            one, other = near_in(words, held["group"], held["size"], held["kind"], held["a"], held["b"])
            # pairs that differ by a letter inserted were asked from the shorter word only
            both = held["kind"][one] == INSERTED
            left, right = np.concatenate((one, other[both])), np.concatenate((other, one[both]))
            for at in range(0, len(left), 50_000):
                i, j = left[at : at + 50_000], right[at : at + 50_000]
                texts = held["word"]
                yield pa.record_batch([pa.array([texts[k] for k in i], pa.string()), pa.array([texts[k] for k in j], pa.string()), pa.array(held["n"][j], pa.int64())], names=["word", "near", "near_n"])

    return dealt.mapInArrow(report, PAIR)


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows sorted by GROUP in parts of whole groups of two words or more, of about TREE_ROWS rows and TREE_BYTES padded bytes."""
    held: list[tuple] = []
    group: list[tuple] = []
    now, widest = None, 0
    for batch in batches:
        for row in zip(*(batch[i].to_pylist() for i in range(7)), strict=True):
            if row[:5] != now:
                if len(group) > 1:
                    width = max(len(r[5]) for r in group)
                    if held and (len(held) + len(group) > TREE_ROWS or (len(held) + len(group)) * max(widest, width) > TREE_BYTES):
                        yield as_arrays(held)
                        held, widest = [], 0
                    held += group
                    widest = max(widest, width)
                group, now = [], row[:5]
            group.append(row)
    if len(group) > 1:
        held += group
    if held:
        yield as_arrays(held)


def as_arrays(rows: list[tuple]) -> dict:
    size, kind, a, b, _, word, n = zip(*rows, strict=True)
    new = np.array([i > 0 and rows[i][:5] != rows[i - 1][:5] for i in range(len(rows))])
    return {"group": np.cumsum(new), "word": word, **{k: np.array(v, np.int64) for k, v in (("size", size), ("kind", kind), ("a", a), ("b", b), ("n", n))}}


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where following forms ends. A form's count at least doubles, so lengths of chains are logarithms, and each round doubles the steps taken."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = FORM_TIMES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n), whose words are distinct.

    ``form`` is the most frequent near word, the least of several in order of code points, if it is ``times`` as
    frequent; ``root`` is where following forms ends, the word itself if it has none.
    """
    words = written(words, "vocabulary")
    best = near_pairs(words, group_rows).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    formed = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the vocabulary of ``docs``."""
    return variants(vocabulary(docs, id_col, text_col))

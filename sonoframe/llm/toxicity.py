"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

One dictionary is trained by zstandard on toxic passages, one on ordinary ones. Both begin with the same common
words, so that a window of ordinary text compresses alike with either and the difference of the two lengths shows
what only toxic text has. Toxic documents are mostly ordinary text, so a toxic document's passage is what in it is
rare elsewhere: words whose document frequencies stand out by a log-likelihood ratio. A window is a word with its
boundaries, followed by a tail that both dictionaries hold: the compressor then always finds something to gain, and
one byte of difference counts. A window is toxic if the toxic dictionary saves at least ``threshold`` bytes. The
ratio that passages need, the threshold and the map from a document's toxic windows to a score are calibrated on
labelled documents that the dictionaries haven't seen.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.common import fold, pieces, resident

#: Bounds of the labelled sample: documents of either label.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000
#: Bytes of the common words that both dictionaries begin with, of a trained part, and of the tail.
SHARED_BYTES, TRAINED_BYTES, TAIL_BYTES = 48_000, 8_000, 40
#: Lengths of the substrings that training counts, and of the segments that it takes.
TRAINED_GRAM, TRAINED_SEGMENT = 6, 32
#: Calibrated: the least log-likelihood ratio of a toxic passage's word, and the bytes that a toxic window saves.
CONTRASTS = (6.0, 12.0, 25.0)
THRESHOLDS = (2, 3, 4, 5)
#: A passage's word is so many times as frequent in toxic documents.
LEAST_RATIO = 5.0
#: Tries for a match; with few, common words hide the spans that lie further back.
SEARCH_LOG = 7
#: Distinct words whose verdict a worker keeps.
CACHED_WORDS = 250_000
LONGEST_WORD = 200
PUNCTUATION = b".,;:!?\"'()[]"

SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_windows", T.LongType()), T.StructField("windows", T.LongType())])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    tail: bytes
    threshold: int
    weights: tuple[float, float, float]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def contrast(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio of a in n against b in m; 0 unless the first share is the larger."""
    if a * m <= b * n:
        return 0.0

    def fit(k: int, of: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((of - k) * math.log(1 - p) if of > k else 0.0)

    p = (a + b) / (n + m)
    return 2 * (fit(a, n, a / n) + fit(b, m, b / m) - (fit(a, n, p) + fit(b, m, p) if p < 1 else 0.0))


class Windows:
    """Compressed lengths of a window with either dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes, tail: bytes):
        import zstandard

        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=SEARCH_LOG, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0)
        one = lambda data: zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.toxic, self.ordinary, self.tail = one(toxic).compress, one(ordinary).compress, tail

    def saved(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves. A longer word is cut into windows of its own; the best one counts."""
        word = word.strip(PUNCTUATION)
        if len(word) > LONGEST_WORD:
            return max(self.saved(word[i : i + LONGEST_WORD]) for i in range(0, len(word), LONGEST_WORD))
        window = b" " + word + b" " + self.tail
        return len(self.ordinary(window)) - len(self.toxic(window))


def content(dictionary: bytes) -> bytes:
    """The text in a trained dictionary: what follows its header, which ends with three offsets."""
    return dictionary[dictionary.index(struct.pack("<3I", 1, 4, 8)) + 12 :]


def trained(passages: list[bytes]) -> bytes:
    """The content of a dictionary that zstandard trains on passages; passages that fit into one whole need no training."""
    import zstandard

    if sum(map(len, passages)) <= TRAINED_BYTES:
        return b"".join(dict.fromkeys(passages))
    try:
        found = zstandard.train_dictionary(TRAINED_BYTES, passages, d=TRAINED_GRAM, k=TRAINED_SEGMENT)
    except zstandard.ZstdError:  # too few passages to choose from
        return b"".join(dict.fromkeys(passages))[-TRAINED_BYTES:]
    return content(found.as_bytes())


def passages(docs: list[list[bytes]], wanted: set[bytes]) -> list[bytes]:
    """Each document's wanted words with their boundaries."""
    found = ([w for w in (x.strip(PUNCTUATION) for x in d) if w in wanted] for d in docs)
    return [b" " + b" ".join(x) + b" " for x in found if x]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: float) -> tuple[bytes, bytes, bytes]:
    """Dictionaries trained on toxic and on ordinary documents, and the tail that they share."""
    a, b = (Counter(w for d in docs for w in {x.strip(PUNCTUATION) for x in d}) for docs in (toxic, ordinary))
    n, m = len(toxic), len(ordinary)
    telling = {w for w in a if w and a[w] * m >= LEAST_RATIO * n * (b[w] + 0.5) and contrast(a[w], n, b[w], m) >= least}
    common = Counter(w for d in ordinary for w in d)
    ranked_words = sorted(common, key=lambda w: (-common[w], w))
    shared = b" ".join(reversed(ranked_words[:8000]))[-SHARED_BYTES:]
    own, others = trained(passages(toxic, telling)), trained(passages(ordinary, set(ranked_words[8000:])))
    end = b"\n" * 16  # the compressor looks up no match in the last bytes
    return shared + b"\n" + own + end, shared + b"\n" + others[: len(own)].ljust(len(own), b" ") + end, shared[-TAIL_BYTES:]


def features(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(hits)), np.log1p(hits), np.log((hits + 0.5) / (n + 50.0))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of which no feature's is negative, so that a text without a toxic window never gains by its length."""
    for use in ([0, 1, 2], [0, 1], [0, 2]):
        w = np.zeros(x.shape[1])
        w[use] = logistic(x[:, use], y)
        if (w[1:] >= 0).all():
            return w
    w = np.zeros(x.shape[1])
    w[:1] = logistic(x[:, :1], y)
    return w


def ranked(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counting half."""
    values, place = np.unique(score, return_inverse=True)
    one, zero = np.bincount(place[y == 1], minlength=len(values)), np.bincount(place[y == 0], minlength=len(values))
    below = np.cumsum(zero) - zero
    return float((one * (below + zero / 2)).sum() / max(1, one.sum() * zero.sum()))


def train(sample: list[tuple[str | None, int]], toxic_share: float | None = None) -> Model | None:
    """Fit on (text, label) rows: two in three for the dictionaries, the others for calibration; all for both where a label has under three. None unless texts with words have both labels.

    ``toxic_share`` is the share of label 1 where the sample comes from, if the sample's own share differs.
    """
    toxic, ordinary = ([w for w in (words(t) for t, y in sample if y == label) if w] for label in (1, 0))
    if not toxic or not ordinary:
        return None
    seen = lambda docs: [d for i, d in enumerate(docs) if i % 3] if len(docs) > 2 else docs
    rest = [(d, 1) for d in (toxic[::3] if len(toxic) > 2 else toxic)] + [(d, 0) for d in (ordinary[::3] if len(ordinary) > 2 else ordinary)]
    y, n = np.array([label for _, label in rest]), np.array([len(d) for d, _ in rest])
    shift = 0.0
    if toxic_share is not None and 0 < toxic_share < 1:
        shift = math.log(toxic_share / (1 - toxic_share)) - math.log(y.sum() / (len(y) - y.sum()))
    best = None
    for least in CONTRASTS:
        both = dictionaries(seen(toxic), seen(ordinary), least)
        windows, kept = Windows(*both), {}
        for w in {w for d, _ in rest for w in d}:
            kept[w] = windows.saved(w)
        saved = [np.array([kept[w] for w in d]) for d, _ in rest]
        for threshold in THRESHOLDS:
            hits = np.array([int((s >= threshold).sum()) for s in saved])
            w = rising(features(hits, n), y)
            loss = float(np.logaddexp(0, np.where(y == 1, -1, 1) * (features(hits, n) @ w)).mean())
            if best is None or loss < best[0]:
                best = (loss, Model(*both, threshold, (float(w[0]) + shift, float(w[1]), float(w[2]))))
    return best[1]


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> tuple[list[tuple[str | None, int]], float | None]:
    """(text, label) rows, and the share of label 1 in all that they are taken from: at most SAMPLE_TOXIC and SAMPLE_ORDINARY documents, in order of a hash of the id, none of them held out.

    Labels other than 0 and 1 and null ids are left out; of repeated labels the highest counts, and of documents
    with one id the least text.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [r for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)) for r in known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not ids:
        return [], None
    share = known.agg(F.avg("toxic")).first()[0]
    some = spark.createDataFrame([(int(r["doc_id"]), int(r["toxic"])) for r in ids], "doc_id long, toxic int")
    found = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: r["doc_id"])], share


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, toxic_windows, windows) for each row, from its whole text alone.

    Null and empty texts have no windows, and the highest score that a text without a toxic window can have: the
    score falls with the number of windows. Without a model, for want of labels of both kinds, every score is 0.
    Repeated and null ids are kept; other columns play no part.
    """
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker(packed)
        for batch in pieces(batches):
            counts = [state.count(t) for t in batch.column(1).to_pylist()]
            hits, n = (np.array([c[i] for c in counts], dtype=np.int64) for i in (0, 1))
            s = np.zeros(len(hits)) if state.model is None else 1 / (1 + np.exp(-np.clip(features(hits, n) @ np.array(state.model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(hits), pa.array(n)], names=SCORED.fieldNames())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns stay as they are."""
    packed, column = pickle.dumps(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker(packed)
        for batch in pieces(batches):
            counts = [state.count(t) for t in batch.column(column).to_pylist()]
            if state.model is not None and counts:
                hits, n = np.array(counts, dtype=np.int64).T
                batch = batch.filter(pa.array(features(hits, n) @ np.array(state.model.weights) < 0))
            yield batch

    return docs.mapInArrow(run, docs.schema)


class Worker:
    def __init__(self, packed: bytes):
        self.packed, self.model = packed, pickle.loads(packed)
        self.windows = Windows(self.model.toxic, self.model.ordinary, self.model.tail) if self.model else None
        self.cold, self.hot = set(), set()

    def count(self, text: str | None) -> tuple[int, int]:
        """Toxic windows and all windows of a text."""
        found = words(text)
        if self.windows is None:
            return 0, len(found)
        if len(self.hot) > CACHED_WORDS:
            self.hot.clear()
        own = set()
        for w in set(found) - self.cold:
            if w in self.hot:
                own.add(w)
            elif self.windows.saved(w) >= self.model.threshold:
                own.add(w)
                if len(self.hot) <= CACHED_WORDS:
                    self.hot.add(w)
            elif len(self.cold) < CACHED_WORDS and len(w) <= 64:
                self.cold.add(w)
        return sum(map(own.__contains__, found)), len(found)


def worker(packed: bytes) -> Worker:
    """This Python worker's state, kept between tasks of the same model."""
    return resident("toxicity", packed, lambda: Worker(packed))

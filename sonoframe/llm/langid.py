"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy.

A word's subwords are its character n-grams (with word boundaries) and the word itself, hashed to buckets. A
text's vector is the mean of its subwords' embeddings; because that and the softmax's input are linear, a worker
keeps each word's summed logits and a text costs one lookup a word. A temperature, fitted on examples that
training hasn't seen, makes the score a probability, and a least score is calibrated for rejection.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.common import fold, pieces, resident, written

UNKNOWN = "und"
#: Bound of the labelled sample, shared evenly by the languages; each has one row at least.
SAMPLE = 2400
BUCKETS, DIMENSION = 1 << 16, 16
GRAMS = range(1, 5)
EPOCHS, BATCH, RATE = 4, 64, 8.0
#: A small sample is passed over more often, up to so many steps.
LEAST_STEPS = 480
#: Words in a training example beside the whole text: each text gives one of each length, so that short texts are known too.
CUTS = (2, 5, 12, 40)
#: The share of known-language texts that rejection may cost.
REJECTED_SHARE = 0.01
HASHES = 1 << 53
#: Rows of languages that are sent to all executors; more are joined.
SENT = 100_000
CACHED_WORDS = 300_000

LETTERS = re.compile(r"[^\W\d_]+")
PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray  # (BUCKETS, DIMENSION)
    weights: np.ndarray  # (DIMENSION, languages)
    bias: np.ndarray
    temperature: float
    least: float


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word, whatever its length; none if it has no letter."""
    if not (word.isalpha() or any(map(str.isalpha, word))):
        return []
    b = f"<{word}>"
    n = len(b)
    found = [zlib.crc32(b[i : i + k].encode()) % BUCKETS for k in GRAMS for i in range(1 if k == 1 else 0, n - k + (0 if k == 1 else 1))]
    found.append(zlib.crc32(b.encode(), 1) % BUCKETS)
    return found


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(sample: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """(buckets, how often each occurs, language): each text whole, and cut at a random place to a few words."""
    out, known = [], {}
    for text, lang in sample:
        found = words(text)
        if not found:
            continue
        at = int(rng.integers(len(found)))
        for part in (found, *(found[at : at + cut] or found[:cut] for cut in CUTS)):
            for w in {w for w in part if w not in known}:
                known[w] = np.array(subwords(w), dtype=np.int32)
            buckets, times = np.unique(np.concatenate([known[w] for w in part]), return_counts=True)
            if len(buckets):
                out.append((buckets, times.astype(np.float32), lang))
    return out


def split(sample: list[tuple[str, str]], rng: np.random.Generator) -> tuple[list, list]:
    """Rows to fit on, and a fifth of each language's, rounded down, to calibrate on."""
    fit, held, seen = [], [], Counter()
    size = Counter(lang for _, lang in sample)
    for i in rng.permutation(len(sample)):
        lang = sample[i][1]
        (held if seen[lang] < size[lang] // 5 else fit).append(sample[i])
        seen[lang] += 1
    return fit, held


def train(sample: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fit on (text, language) rows. None if no row has a letter."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for text, lang in sample if words(text)})
    if not langs:
        return None
    fitted, held = split([(t, lang) for t, lang in sample if words(t)], rng)
    fit = examples(fitted, rng)
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.array([number[lang] for _, _, lang in fit])
    e = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    w, bias = np.zeros((DIMENSION, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    batches = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(fit))
        for start in range(0, len(fit), BATCH):
            part = shuffled[start : start + BATCH]
            sizes = np.array([len(fit[i][0]) for i in part])
            flat, times = (np.concatenate([fit[i][k] for i in part]) for k in (0, 1))
            owner, starts = np.repeat(np.arange(len(part)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))
            share = times / np.add.reduceat(times, starts)[owner]
            vectors = e[flat]
            mean = np.column_stack([np.bincount(owner, vectors[:, d] * share, len(part)) for d in range(DIMENSION)]).astype(np.float32)
            p = softmax(mean @ w + bias)
            p[np.arange(len(part)), y[part]] -= 1
            rate = RATE * (1 - done / steps) / len(part)
            back = (p @ w.T).astype(np.float32)
            w -= (rate * mean.T @ p).astype(np.float32)
            bias -= (rate * p.sum(axis=0)).astype(np.float32)
            change = (-rate * share)[:, None] * back[owner]
            for d in range(DIMENSION):
                e[:, d] += np.bincount(flat, change[:, d], BUCKETS)
            done += 1
    model = Model(langs, e, w, bias, 1.0, 0.0)
    check = examples(held, rng)
    if check and len(langs) > 1:
        z = np.array([(t / t.sum()) @ e[b] @ w + bias for b, t, _ in check])
        truth = np.array([number[lang] for _, _, lang in check])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean()
        model.temperature = min((float(t) for t in np.geomspace(0.25, 8, 41)), key=loss)
        model.least = float(np.quantile(softmax(z / model.temperature).max(axis=1), REJECTED_SHARE))
    return model


def labelled_sample(docs: DataFrame, folds: int, held_out: int) -> list[tuple[str, str]]:
    """At most SAMPLE (text, language) rows outside the held-out fold, or one a language if there are more languages: the first of each by a hash of the id.

    Rows without a text, a language or an id are left out.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out)).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    quota = F.greatest(F.lit(1), F.floor(F.lit(SAMPLE) / F.lit(max(1, languages))))
    # hashes under a bound hold some times the rows that are wanted, so few rows are sorted
    few = F.pmod("h", F.lit(HASHES)) <= F.lit(float(HASHES)) * 4 * (quota + 8) / F.col("n")
    some = known.join(F.broadcast(counts) if languages <= SENT else counts, "lang").where(few)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    rows = some.withColumn("place", place).where(F.col("place") <= quota).select("text", "lang", "h", "doc_id").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"], r["lang"], r["text"]))]


class Worker:
    """A model with each known word's summed logits: columns for the languages, then the number of subwords."""

    def __init__(self, packed: bytes):
        self.packed, self.model = packed, pickle.loads(packed)
        if self.model:
            self.project = self.model.embedding @ self.model.weights
            self.rows: dict[str, int] = {}
            self.table = np.zeros((1 << 10, len(self.model.langs) + 1), dtype=np.float32)
            self.used = 0

    def learn(self, new: list[str]) -> None:
        buckets = [subwords(w) for w in new]
        sizes = np.array([len(b) for b in buckets])
        flat = np.fromiter((h for b in buckets for h in b), dtype=np.int32, count=int(sizes.sum()))
        made = np.zeros((len(new), self.table.shape[1]), dtype=np.float32)
        if len(flat):
            some = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[some]
            made[some, :-1] = np.add.reduceat(self.project[flat], starts, axis=0)
        made[:, -1] = sizes
        while self.used + len(new) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.used : self.used + len(new)] = made
        self.rows.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.model:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        split = [words(t) for t in texts]
        if self.used > CACHED_WORDS:
            self.rows, self.used = {}, 0
        new = {w for found in split for w in found if w not in self.rows}
        if new:
            self.learn(sorted(new))
        get = self.rows.__getitem__
        total = np.array([self.table[np.fromiter(map(get, found), dtype=np.int64, count=len(found))].sum(axis=0, dtype=np.float64) if found else np.zeros(self.table.shape[1]) for found in split])
        n = total[:, -1:]
        p = softmax((total[:, :-1] / np.maximum(n, 1) + self.model.bias) / self.model.temperature)
        best = p.argmax(axis=1)
        none = n[:, 0] == 0
        return [UNKNOWN if x else self.model.langs[i] for i, x in zip(best, none, strict=True)], np.where(none, 0.0, p.max(axis=1))


def worker(packed: bytes) -> Worker:
    """This Python worker's state, kept between tasks of the same model."""
    return resident("langid", packed, lambda: Worker(packed))


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for each row, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model. ``accepted``
    is false for those and where the score is under the calibrated least score. Repeated and null ids are kept.
    """
    packed = pickle.dumps(model)
    least = model.least if model else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker(packed)
        for part in pieces(batches, 256):
            langs, scores = state(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array([x != UNKNOWN and bool(s >= least) for x, s in zip(langs, scores, strict=True)], pa.bool_())], names=PREDICTED.fieldNames())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PREDICTED)

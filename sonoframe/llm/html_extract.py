"""Main text of web pages: a recurrent labeller reads each page's leaf blocks as one sequence.

Every block is described by its tag path, its hashed words and a few numbers; a bidirectional LSTM then labels
each block with the whole page in view. The labeller is trained once a driver, on made-up pages of many layouts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import lstm, page_templates
from sonoframe.llm.common import pieces
from sonoframe.llm.html_blocks import blocks, describe

TRAINING_PAGES, EPOCHS = 1800, 6
#: Blocks that are labelled at once.
BATCH_BLOCKS = 6000

EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])


def examples(n: int, seed: int) -> tuple[list, list]:
    """Described pages and labels, for pages whose blocks come out as they were made."""
    described, labels = [], []
    for page, truth in page_templates.pages(n, seed):
        found = blocks(page)
        if [b.text for b in found] == [text for text, _ in truth]:
            described.append(describe(found))
            labels.append(np.array([kept for _, kept in truth]))
    return described, labels


@lru_cache(maxsize=2)
def labeller(n: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 1) -> lstm.Labeller:
    return lstm.train(*examples(n, seed), epochs=epochs)


def extract_pages(pages: list[str | None], model: lstm.Labeller) -> list[tuple[str, int, int]]:
    """(main text, blocks, blocks kept) of each page."""
    found = [blocks(p) for p in pages]
    out: list = [("", 0, 0)] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    start = 0
    while start < len(order):
        # pages of like length side by side, so that little is padded
        stop, longest = start, 0
        while stop < len(order):
            longest = max(longest, len(found[order[stop]]))
            if stop > start and longest * (stop - start + 1) > BATCH_BLOCKS:
                break
            stop += 1
        part = order[start:stop]
        for i, p in zip(part, lstm.predict(model, [describe(found[i]) for i in part]), strict=True):
            kept = [b.text for b, x in zip(found[i], p, strict=True) if x >= 0.5]
            out[i] = ("\n".join(kept), len(found[i]), len(kept))
        start = stop
    return out


def extract(pages: DataFrame, *, model: lstm.Labeller | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for each row: the main text of its whole page.

    A null or empty page, and one without a block of content, gives an empty text. Blocks are joined by one line
    feed; within a block white space is folded and references are decoded. Ids and urls are passed on as they
    are, nulls and repeated rows too; other columns play no part.
    """
    packed = pickle.dumps(model or labeller())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(packed)
        for part in pieces(batches, 250):
            found = extract_pages(part.column(2).to_pylist(), known)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([k for _, _, k in found], pa.int64())], names=EXTRACTED.fieldNames()
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, EXTRACTED)

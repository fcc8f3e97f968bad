"""Which words of a table stand in which texts of another: a join on containment without pairing all rows.

A small table of words becomes an automaton that tasks run along their texts. A large one is joined by equality: each
word is looked up by the one of its q-grams that the fewest words share, texts offer their distinct q-grams that any
word is looked up by, and pairs that meet are checked. Tasks pass over what no word is looked up by with a table of
bits, whose size doesn't depend on the words. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.sources.scratch import drop, stored

#: Letters of the words up to which an automaton is built: some 100 bytes a letter in each worker.
AUTOMATON_LETTERS = 1_000_000
GRAM = 5
#: Letters of texts whose q-grams are hashed at once.
PIECE = 262_144
#: The table of bits has two to this power, 2 MB, and not below 15; with many millions of q-grams it lets all pass, and the joins do the work.
BITS = 24


def mentions(texts: DataFrame, words: DataFrame, *, key: str = "doc_id", text: str = "text", word: str = "word", most_letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """(key, word) for each distinct word that is a substring of a row's text, case and all.

    Null and empty words are in no text, nor is anything in a null one or one with a null key. Rows of ``texts`` with
    the same key are one.
    """
    known = stored(words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct(), "words")
    # the size is measured, not guessed: a table over the bound goes the other way
    letters = known.agg(F.sum(F.length("word"))).first()[0] or 0
    wanted = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key IS NOT NULL AND _text IS NOT NULL")
    found = by_automaton(wanted, known, texts.schema[key].dataType.simpleString()) if letters <= most_letters else by_grams(wanted, known)
    return found.select(F.col("_key").alias(key), "word").distinct()


def by_automaton(texts: DataFrame, words: DataFrame, kind: str) -> DataFrame:
    """For words of a bounded size. Workers build the automaton once a task."""
    listed = sorted(r["word"] for r in words.collect())  # bounded by the caller

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in listed:
            machine.add_word(w, w)
        if listed:
            machine.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for i, body in enumerate(batch["_text"]):
                found = {w for _, w in machine.iter(body.as_py())} if listed else ()
                rows += [i] * len(found)
                hits += found
            yield pa.record_batch([batch["_key"].take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["_key", "word"])

    return texts.mapInArrow(search, f"_key {kind}, word string")


def by_grams(texts: DataFrame, words: DataFrame, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """For any number of words. A q-gram that many words are looked up by is a skewed key of joins by equality, which adaptive execution splits."""
    # words shorter than a q-gram are looked up by themselves, and texts offer pieces of those lengths too
    size = F.least(F.length("word"), F.lit(gram))
    places = F.sequence(F.lit(1), F.length("word") - size + 1)
    grams = words.select("word", size.alias("size"), F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col("word"), p, size)))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("word").orderBy("n", "gram")
    looked_up = stored(grams.join(shared, "gram").withColumn("_r", F.row_number().over(rarest)).where("_r = 1").select("word", "gram", "size"), "grams")
    sizes = sorted(r["size"] for r in looked_up.select("size").distinct().collect())  # 1 to ``gram``
    if not sizes:
        drop(looked_up)
        return texts.select("_key", F.lit("").alias("word")).where(F.lit(False))
    offered = offers(texts, looked_up, sizes, bits)
    # a word has one q-gram, so a text meets it once for each time that it offers that
    pairs = offered.join(looked_up.select("gram", "word"), "gram").select("_key", "word")
    return pairs.join(texts, "_key").where(F.contains("_text", F.col("word"))).select("_key", "word")


def hashes(letters: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A number below 2**bits for each run of ``size`` code points."""
    n = len(letters) - size + 1
    h = np.full(max(n, 0), size, np.uint64)
    for k in range(size):
        h = (h ^ letters[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def offers(texts: DataFrame, looked_up: DataFrame, sizes: list[int], bits: int) -> DataFrame:
    """(_key, gram): the distinct q-grams of each text, or of each piece of a long one, that words are looked up by, and a few others."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch["gram"].to_pylist()
            # a number is counted from 1 in the bitmap functions
            yield pa.record_batch([pa.array([int(hashes(code_points(g), len(g), bits)[0]) + 1 for g in grams], pa.int64())], names=["place"])

    place = F.col("place")
    marked = looked_up.select("gram").mapInArrow(places, "place long").groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table, width = np.zeros(1 << (bits - 3), np.uint8), 4096
    for r in marked.collect():  # 2 MB at most
        table[(r["k"] - 1) * width : r["k"] * width] = np.frombuffer(r["bits"], np.uint8)

    def found(pieces: list[str]) -> list[set[str]]:
        """The q-grams of each piece whose bits are set."""
        ends = np.cumsum([len(p) for p in pieces])
        letters, line, out = code_points("".join(pieces)), "".join(pieces), [set() for _ in pieces]
        for size in sizes:
            h = hashes(letters, size, bits)
            at = np.flatnonzero(table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1)
            row = np.searchsorted(ends, at, "right")
            within = at + size <= ends[row]
            for r, a in zip(row[within].tolist(), at[within].tolist(), strict=True):
                out[r].add(line[a : a + size])
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overlap = sizes[-1] - 1

        def told(keys: pa.Array, rows: list[int], pieces: list[str]) -> pa.RecordBatch:
            sets = found(pieces)
            index = np.repeat(np.array(rows, np.int64), [len(s) for s in sets])
            return pa.record_batch([keys.take(pa.array(index)), pa.array([g for s in sets for g in s], pa.string())], names=["_key", "gram"])

        for batch in batches:
            rows, pieces, held = [], [], 0
            for i, body in enumerate(batch["_text"]):
                text = body.as_py()
                for start in range(0, len(text), PIECE):
                    rows.append(i)
                    pieces.append(text[start : start + PIECE + overlap])
                    held += len(pieces[-1])
                    if held >= PIECE:
                        yield told(batch["_key"], rows, pieces)
                        rows, pieces, held = [], [], 0
            if pieces:
                yield told(batch["_key"], rows, pieces)

    return texts.mapInArrow(search, f"_key {texts.schema['_key'].dataType.simpleString()}, gram string")

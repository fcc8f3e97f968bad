"""Removal of repeated byte strings against a plain scan of all of them."""

import hashlib
import random

import pytest

from sonoframe.llm import suffix_dedup
from tests_brute import plain_repeats as plain


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeföß") for _ in range(rng.randint(2, 9))) for _ in range(n))


def planted():
    rng = random.Random(8)
    passages = [words(rng, 40) for _ in range(4)] + ["x" * 400, "ab" * 160]
    texts = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : cut + rng.randint(60, 300)], words(rng, rng.randint(0, 10))]
        texts.append("".join(parts))
    return texts + [None, "", "short", texts[0], texts[0], "z" * 99, "z" * 100, "z" * 101, passages[0] * 3]


def check(spark, texts, **patched):
    docs = spark.createDataFrame([(3 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect()}
    want = {3 * i + 1: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in enumerate(plain(texts))}
    assert got == want


def test_planted_passages(spark):
    check(spark, planted())


@pytest.mark.parametrize("classes", [1, 5])
def test_grams_too_frequent_for_a_task(spark, monkeypatch, classes):
    monkeypatch.setattr(suffix_dedup, "GRAM_CLASSES", classes)
    check(spark, planted())


@pytest.mark.parametrize("hot, classes", [(1000, 20_000), (2, 20_000), (2, 3)])
def test_small_slices_and_hot_names(spark, monkeypatch, hot, classes):
    """Texts longer than a slice, and names that are dealt by their triples."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "HOT_SLICES", hot)
    monkeypatch.setattr(suffix_dedup, "GRAM_CLASSES", classes)
    check(spark, planted())


def test_the_cover_meets_every_pair_of_places():
    for i in range(suffix_dedup.MODULUS):
        for j in range(i):
            shifts = [k for k in range(suffix_dedup.MODULUS) if (i + k) % suffix_dedup.MODULUS in suffix_dedup.COVER and (j + k) % suffix_dedup.MODULUS in suffix_dedup.COVER]
            assert len(shifts) == 1


def test_corpus(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {r["doc_id"]: w[:3] + (hashlib.sha256(w[3]).hexdigest(),) for r, w in zip(rows, plain([r["text"] for r in rows]), strict=True)}
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0


def test_repeated_and_null_ids_and_clashing_columns(spark):
    rng = random.Random(2)
    a, b = words(rng, 50), words(rng, 50)
    rows = [(5, a, 0, "r", 1), (5, a, 0, "s", 2), (None, b, 0, "t", 3), (7, b, 0, None, 4), (None, None, None, "u", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _row string, row int")
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    found = sorted(got.collect(), key=lambda r: str(r["_row"]))
    by = {r["row"]: r for r in found}
    assert sorted([by[1]["text"], by[2]["text"]]) == sorted([a, ""])
    assert (by[4]["text"], by[3]["text"], by[None]["text"]) == (b, "", "")
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["_row"] for r in found} == {"r", "s", "t", None, "u"}
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0

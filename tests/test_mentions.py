"""Words of a table in texts, by joins on q-grams: pieces of long texts, all letters, and how often texts are read."""

import pytest

from sonoframe.operators import mentions as m


def both(spark, texts, words):
    t = spark.createDataFrame(texts, "doc_id long, text string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    want = sorted({(k, x) for k, body in texts if k is not None and body is not None for x in words if x and x in body})
    got = sorted((r["doc_id"], r["word"]) for r in m.mentions(t, w, most_letters=0).collect())
    assert got == want
    return m.mentions(t, w, most_letters=0)


@pytest.mark.parametrize("piece", [7, 64, m.PIECE])
def test_grams_meet_across_pieces_but_not_across_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(m, "PIECE", piece)
    texts = [(1, "abcdefghijklmnopqrstuvwxyz" * 3), (2, "abc"), (3, "def"), (4, "漢字かな\U0001f600交じり\0文"), (5, ""), (6, None), (None, "abc"), (7, "a" * 50)]
    both(spark, texts, ["a", "ab", "cdef", "zabcd", "vwxyzabcdefghi", "字か", "\U0001f600交", "\U0001f600", "り\0文", "aaaaaaaaa", "", None, "zz"])


def test_each_text_is_read_twice_whatever_the_lengths_of_words(spark):
    found = both(spark, [(k, f"text {k} of some words") for k in range(50)], ["t", "te", "tex", "text", "text 1", "some words"])
    # once for its q-grams, once to check what was found
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan


def test_a_crowded_table_of_bits_only_lets_more_pass(spark):
    texts = spark.createDataFrame([(k, f"{k * k} and {k}") for k in range(60)], "_key long, _text string")
    words = spark.createDataFrame([(str(k),) for k in range(20_000)], "word string")
    got = {tuple(r) for r in m.by_grams(texts, words, bits=15).collect()}
    assert got == {(k, str(n)) for k in range(60) for n in range(20_000) if str(n) in f"{k * k} and {k}"}

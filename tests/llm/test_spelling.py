"""Spelling variants against all pairs, split groups, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from sonoframe.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_words(docs):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(others), form[w], words[form[w]] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def test_given_documents_and_odd_rows(spark, sf):
    odd = [(None, "Häuser HÄUSER hÄuser häuser"), (7, None), (8, ""), (9, "wordsword " * 5 + "wordwords " * 2 + "×÷×÷× " * 3 + "naïve1naïve naïve_naïve"), (10, "z" * 200_000 + " " + ("z" * 199_999 + " ") * 3 + "日本語 abcde日abcde abcde"), (10, "same abcde same abcde")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    words = plain_words([tuple(r) for r in docs.collect()])
    assert got(spelling.spelling_variants(docs)) == plain_variants(words)


def test_groups_are_split_down_to_one_place(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(500)})
    rows = [(w, rng.randint(3, 60)) for w in words]
    df = spark.createDataFrame(rows, "word string, n long")
    want = plain_variants(dict(rows))
    for most in (20_000, 3):
        assert got(spelling.variants(df, group_rows=most)) == want
    parts = spelling.bounded(spelling.grouped(df), 3).groupBy(*spelling.GROUP).count().where("count > 3 AND b - a > 1")
    assert parts.isEmpty()


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        x = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        y = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        which, value = spelling.Wavelet(values).report(x[:, 0], x[:, 1], y[:, 0], y[:, 1])
        want = sorted((q, int(v)) for q in range(50) for v in values[x[q, 0] : x[q, 1]] if y[q, 0] <= v < y[q, 1])
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == want


def test_empty_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string, word string")).collect() == []
    one = spelling.variants(spark.createDataFrame([("alone", 3)], "word string, n long")).collect()
    assert [tuple(r) for r in one] == [("alone", 3, 0, None, None, "alone")]

"""Toxicity, language and main text: accuracy on what wasn't learned from, and odd inputs."""

import zlib

import pytest

from sonoframe.llm import html_extract, langid, page_templates, queries, toxicity

LARGER = "/root/testdata/sf0.01"
#: Large enough to hold out a hundred toxic documents.
LARGEST = "/root/testdata/sf0.1"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "?! 123 _"), (5, "x" * 300_000), (5, "x" * 300_000), (None, "ther " * 60_000)]


def test_toxicity_of_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGEST}/labels.parquet").collect()}
    rows = queries.QUERIES["op1_toxicity"](spark, LARGEST).collect()
    assert len(rows) == spark.read.parquet(f"{LARGEST}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    toxic = [p for p, y in held if y]
    assert toxic and sum(toxic) >= 0.8 * len(toxic)


def test_toxicity_of_odd_texts(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = toxicity.train(*toxicity.labelled_sample(docs, spark.read.parquet(f"{LARGER}/labels.parquet"), 5, 0))
    odd = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "doc_id AS score", "text AS windows")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(EDGES) and all(r["predicted"] == 0 for r in rows)
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(EDGES)
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert [r["score"] for r in toxicity.score(odd, None).collect()] == [0.0] * len(EDGES)
    assert toxicity.train([("a", 1), (None, 0)]) is None
    assert toxicity.without_toxic(odd, None).count() == len(EDGES)


def test_the_held_out_fold_is_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    held = "crc32(cast(doc_id AS string)) % 5 = 0"
    sample = toxicity.labelled_sample(docs, labels, 5, 0)
    assert sample == toxicity.labelled_sample(docs, labels.selectExpr("doc_id", f"CASE WHEN {held} THEN 1 - toxic ELSE toxic END AS toxic"), 5, 0)
    held = "crc32(cast(doc_id AS string)) % 3 = 1"
    assert langid.labelled_sample(docs, 3, 1) == langid.labelled_sample(docs.selectExpr("doc_id", "text", f"CASE WHEN {held} THEN 'xx' ELSE lang END AS lang"), 3, 1)


def test_languages_of_the_held_out_fold(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_language_id"](spark, LARGER).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.95 * len(held)


def test_languages_of_odd_texts(spark):
    model = langid.train(langid.labelled_sample(spark.read.parquet(f"{LARGER}/documents.parquet"), 3, 1))
    odd = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "doc_id AS lang_pred")
    rows = sorted(langid.predict(odd, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["lang_pred"] == "und" for r in rows] == [True] * 4 + [False] * 3
    assert [r["score"] for r in rows[:4]] == [0.0] * 4 and not any(r["accepted"] for r in rows[:4])
    assert langid.predict(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train([])).collect()} == {"und"}


ARTICLE = """<html><head><title>T</title><style>p {color: red}</style></head><body>
<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<article class="post"><h1>A long walk &amp; what came of it</h1>
<p>We set out in the  early
morning, when the fields were still wet, and walked for hours along the river without meeting anyone.</p>
<p>By noon the sun stood high over the hills, and the dog had found a place in the shade that it would not leave.</p></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten tips</a></li><li><a href="/2">Cheap cars</a></li></ul></aside>
<footer class="footer"><p>© 2024 All rights reserved</p></footer><script>var x = "<p>no</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def model():
    return html_extract.labeller()


def test_main_text_of_a_plain_page(model):
    text, _, kept = html_extract.extract_pages([ARTICLE], model)[0]
    assert kept == 3
    assert text.split("\n")[0] == "A long walk & what came of it"
    assert text.split("\n")[1].startswith("We set out in the early morning, when")


def test_blocks_of_made_up_pages_that_were_not_learned_from(model):
    made = page_templates.pages(150, seed=991)
    right = whole = 0
    for (html, truth), (text, _, _) in zip(made, html_extract.extract_pages([h for h, _ in made], model), strict=True):
        want, got = [t for t, main in truth if main], text.split("\n") if text else []
        right += 2 * len(set(want) & set(got))
        whole += len(set(want)) + len(set(got))
    assert right >= 0.95 * whole


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<div" * 2000), (4, "u", "<div" * 2000), (5, "u", "<nav><a>Home</a></nav>"), (6, "u", "&#0;&#xD800;&bogus;" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS text", "page_id AS n_chars")
    found = html_extract.extract(pages, model=model).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["text"] for r in found if r["page_id"] in (1, 2)} == {""}
    assert html_extract.extract(pages.limit(0), model=model).count() == 0

"""The registered queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm import embedding_dedup, html_extract, langid, media, mixing, packing, pii, prefix_trie, records, simhash, spelling, suffix_dedup, toxicity
from sonoframe.llm.common import fold, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed by the query's contract.
END_ID = 2
TOXIC_FOLDS, TOXIC_HELD_OUT = 5, 0
LANG_FOLDS, LANG_HELD_OUT = 3, 1


#: crc32 of the bytes that ``h`` spells in hexadecimal: each byte, then a step for each of its bits.
SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length(h) // 2), lambda i: [('0x' || substr(h, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""

SQL_TRIE = f"""
WITH hashed AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS whole
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, role, text, left(sha256(whole), 32) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(whole), 32)) AS place FROM hashed),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {SQL_CRC} % 4 AS heads FROM (SELECT DISTINCT conv_id, hex(encode(conv_id::VARCHAR)) AS h FROM own)),
laid AS (
  SELECT i.conv_id, o.key, o.text, o.place, 0 AS part FROM ids i JOIN own o ON o.conv_id = i.base AND o.place <= i.heads
  UNION ALL SELECT i.conv_id, o.key, o.text, o.place, 1 FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.heads),
rebuilt AS (SELECT conv_id, key, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM laid),
path AS (
  SELECT conv_id, depth, sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
ends AS (SELECT conv_id, max(depth) AS size FROM path GROUP BY conv_id),
nodes AS (
  SELECT p.node, min(p.conv_id) AS conv_id, any_value(p.depth) AS depth, any_value(p.words) AS words, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN e.size = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM path p JOIN ends e ON e.conv_id = p.conv_id GROUP BY p.node),
parents AS (SELECT n.node, q.node AS parent FROM nodes n JOIN path q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
children AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent),
under AS (
  SELECT q.node, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves
  FROM nodes n JOIN path q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN children c ON c.node = n.node GROUP BY q.node)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under u ON u.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN parents p ON p.node = n.node LEFT JOIN nodes m ON m.node = p.parent
"""

SQL_SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM counted),
hashed AS (SELECT run, c, {SQL_CRC} AS crc FROM coded),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN crc % 97 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, n, i, left(word, i) AS l, substr(word, i + 2) AS r FROM words, unnest(range(length(word))) AS t(i)),
shorter AS (SELECT DISTINCT word, n, l || r AS cut FROM cuts),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.l = y.l AND x.r = y.r AND x.word <> y.word
  UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.cut = w.word
  UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.cut = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN b.most >= 2 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.most) END AS form,
         CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, coalesce(form, word) AS at FROM formed
  UNION SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.at AS root FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_token_records")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a framed record of token ids, described from the files as read back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.token_digests(docs, scratch(spark, "records"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)


@query("op8_media_payload")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored in a baseline JPEG, and what a decoder reads back from the file."""
    return media.media_features(media.store_payloads(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_simhash_components")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and the least document of its component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), TOXIC_FOLDS, TOXIC_HELD_OUT))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", TOXIC_FOLDS) == TOXIC_HELD_OUT).alias("held_out"), "score", "predicted", "toxic_windows", "windows")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.labelled_sample(docs, LANG_FOLDS, LANG_HELD_OUT))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", LANG_FOLDS) == LANG_HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")


@query("op10_source_mix", mixing.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document for each pass of the mix that takes it, with its source's weight and its place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", packing.word_count().alias("tokens"))
    mixed = mixing.mix(docs, tokens=F.col("tokens"))
    return mixed.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_block").alias("block"), F.col("mix_epoch").alias("epoch"), "tokens", F.round("mix_weight", 9).alias("weight"), F.round("mix_progress", 9).alias("progress")
    )


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, cut into pieces and packed best-fit into sequences of the permitted lengths."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)


@query("op4_embedding_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of 0.9 and the least vector of its component."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, by a recurrent labeller of its blocks."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op5_suffix_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated 100-byte strings."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op13_personal_data")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: what the rules find, and what boosted trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, pii.train(docs)))


@query("op11_conversation_trie", SQL_TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_spelling_variants", SQL_SPELLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with the words one edit apart, its usual form and that form's."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))

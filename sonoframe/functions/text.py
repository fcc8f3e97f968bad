"""Transcript text: normal form, tokens and quality, as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.columns import doubles, strings

#: Full-width punctuation and what stands for it, decoration, fillers, token ends, plain punctuation.
WIDE, NARROW = "，。；：？！", ",.;:?!"
DECORATION = r"[`~^*_=+|\\]+"
FILLERS = r"(?U)\b(um+|uh+|emm+)\b"
TOKEN_ENDS = r"(?U)[\s,.;:!?]+"
ODD = r"""[^\p{L}\p{N} ,.;:!?'"\-/]"""


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    from unicodedata import normalize as form

    return strings([form("NFKC", x.as_py()) if x.is_valid else None for x in text])


def in_nfkc(text: Column) -> Column:
    """NFKC of a text. Only those with other characters than ASCII are sent to Python."""
    return F.coalesce(nfkc(F.when(F.octet_length(text) != F.char_length(text), text)), text)


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matched length over the whole length, by longest matching blocks; 0 if either side is empty."""
    from difflib import SequenceMatcher

    return doubles([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column | str, *, unicode_form: bool = True) -> Column:
    """Comparable form of a transcript. ``unicode_form`` off keeps the whole expression in the JVM, for text known to be in NFKC."""
    text = text_or_empty(c)
    text = F.lower(strip(in_nfkc(text) if unicode_form else text))
    text = F.translate(text, WIDE, NARROW)
    text = F.regexp_replace(text, DECORATION, " ")
    text = F.regexp_replace(text, FILLERS, " ")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, TOKEN_ENDS), lambda x: x != "")


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def repetition_ratio(words: Column) -> Column:
    """How much of the tokens repeats earlier ones."""
    n = F.size(words)
    return share((n - F.size(F.array_distinct(words))).cast("double"), n)


def longest_run(words: Column) -> Column:
    """Length of the longest run of one token."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(acc["last"] == word, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(word.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(words, start, step, lambda acc: acc["most"])


def longest_run_ratio(words: Column) -> Column:
    return share(longest_run(words).cast("double"), F.size(words))


def abnormal_ratio(normal: Column) -> Column:
    """Share of characters that are neither letters, digits nor plain punctuation; 1 if there are none."""
    odd = F.char_length(normal) - F.char_length(F.regexp_replace(normal, ODD, ""))
    return share(odd.cast("double"), F.char_length(normal), 1.0)


def hotword_hits(normal: Column, hotwords: Column) -> Column:
    """How many entries of a list of normalized hotwords occur in a text."""
    return F.size(F.filter(F.coalesce(hotwords, F.array().cast("array<string>")), lambda h: (h != "") & F.contains(normal, h)))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def quality(normal: Column, hotwords: Column, boost: float) -> Column:
    """Score and its parts, rounded to four places (by way of nine, so that a tie's binary neighbour rounds as it does); an empty text scores 0 with all ratios 1."""

    def rounded(n: Column, m: Column) -> Column:
        score = 1.0 - F.least(F.lit(0.45), m["rep"] * 0.7) - F.least(F.lit(0.35), m["run"] * 0.6) - F.least(F.lit(0.30), m["odd"] * 0.5) + F.least(F.lit(0.35), m["hits"] * F.lit(boost))
        parts = [("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 0.0), ("repetition_ratio", m["rep"], 1.0), ("longest_run_ratio", m["run"], 1.0), ("abnormal_char_ratio", m["odd"], 1.0), ("hotword_hits", m["hits"], 0.0)]
        return F.struct(*[F.when(n == "", F.lit(empty)).otherwise(F.round(F.round(x, 9), 4)).alias(name) for name, x, empty in parts])

    def measured(n: Column, words: Column) -> Column:
        return F.struct(repetition_ratio(words).alias("rep"), longest_run_ratio(words).alias("run"), abnormal_ratio(n).alias("odd"), hotword_hits(n, hotwords).cast("double").alias("hits"))

    return let(normal, lambda n: let(tokens(n), lambda words: let(measured(n, words), lambda m: rounded(n, m))))

"""Algebra of hotword lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.text import let, normalize, strip

#: Extracted hotwords are shorter than this, in code points.
EXTRACTED_LENGTH = 10
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


#: How HTML names its signs, the ampersand first, and what a hit is wrapped in.
HTML_NAMES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;"))
MARK = '<mark class="hotword-hit">'


def empty() -> Column:
    return F.array().cast("array<string>")


def sanitize(words: Column) -> Column:
    """Trimmed, without blanks and repeats, in order of first occurrence; a null list is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(words, empty()), strip), lambda w: w.isNotNull() & (w != "")))


def normalized(words: Column) -> Column:
    """Each entry's normal form, blanks left out; for lists that are plain ASCII or in NFKC already."""
    return F.filter(F.transform(F.coalesce(words, empty()), lambda w: normalize(w, unicode_form=False)), lambda w: w != "")


def keep_reported(reported: Column, known: Column) -> Column:
    """Reported words whose normal form is a known word's, in order and with repeats."""
    return let(normalized(known), lambda forms: F.filter(F.coalesce(reported, empty()), lambda w: F.array_contains(forms, normalize(w, unicode_form=False))))


def merge(now: Column, new: Column) -> Column:
    """The list with the new words that it lacks, and how many were added: struct(words, added, total)."""
    held, more = sanitize(now), sanitize(new)
    words = F.array_union(held, more)
    return F.struct(words.alias("words"), (F.size(words) - F.size(held)).alias("added"), F.size(words).alias("total"))


def short_enough(words: Column) -> Column:
    return F.filter(words, lambda w: F.char_length(w) < EXTRACTED_LENGTH)


def read_bucket(stored: Column) -> Column:
    """A language's stored hotwords: a JSON list of strings; nothing, or anything else, gives an empty list."""
    return F.coalesce(F.from_json(stored, "array<string>"), empty())


def write_bucket(words: Column) -> Column:
    return F.to_json(F.coalesce(words, empty()))


#: Words for nothing.
NOTHING = ("", "n/a", "na", "none", "null", "-")


def parse_list(value: Column) -> Column:
    """A field of words between commas or semicolons, of either width; words for nothing give an empty list."""
    text = strip(F.coalesce(value, F.lit("")))
    words = F.filter(F.transform(F.split(text, "[,，;；]"), strip), lambda w: w != "")
    return F.when(F.lower(text).isin(*NOTHING), empty()).otherwise(words)


def parse_csv(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip), lambda w: w != "")


@F.pandas_udf(SPANS)
def highlight_spans(text: pd.Series, words: pd.Series) -> pd.Series:
    """Places of trimmed hotwords in a text, case aside: earliest first, longer before shorter, none over another. Code points, ends exclusive."""

    def one(body: str | None, known) -> list[dict]:
        # a pattern finds places in the text as it is; lower-casing it could change its length
        patterns = {re.escape(w) for w in ((x or "").strip() for x in (known if known is not None else [])) if w}
        found = [(m.start(), -m.end()) for p in patterns for m in re.finditer(p, body or "", re.IGNORECASE)]
        kept, end = [], 0
        for start, stop in sorted(found):
            if start >= end:
                end = -stop
                kept.append({"start": start, "stop": end})
        return kept

    return pd.Series([one(t, w) for t, w in zip(text, words, strict=True)])


def highlight_count(text: Column, words: Column) -> Column:
    return F.size(highlight_spans(text, words))


def escaped(text: Column) -> Column:
    """Text as HTML shows it."""
    for sign, name in HTML_NAMES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlighted(text: Column, spans: Column) -> Column:
    """The text as HTML with its spans marked, all of it escaped."""
    body = F.coalesce(text, F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(a: Column, s: Column) -> Column:
        before, hit = F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.substring(body, s["start"] + 1, s["stop"] - s["start"])
        return F.struct(s["stop"].alias("at"), F.concat(a["done"], escaped(before), F.lit(MARK), escaped(hit), F.lit("</mark>")).alias("done"))

    return F.aggregate(spans, begin, step, lambda a: F.concat(a["done"], escaped(F.substring(body, a["at"] + 1, F.length(body)))))

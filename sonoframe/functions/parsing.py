"""Fields out of the semi-structured answers of speech models."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.hotwords import NOTHING, parse_list
from sonoframe.functions.text import let, strip, text_or_empty

#: Language codes and names, words for nothing, emotion labels, keys that hold an answer.
LANGUAGES = {"zh": "Chinese", "cn": "Chinese", "en": "English", "id": "Indonesian", "th": "Thai"}
EMOTIONS = ("Neutral", "Happy", "Sad", "Angry", "Fear", "Disgust", "Surprise", "Other/Complex")
LABEL_KEYS, SUMMARY_KEYS = ("label", "emotion", "class"), ("summary", "description", "text", "caption")
MODES = ("ser", "sec")
FENCE = r"(?s)^```(?:json)?\s*(.*?)\s*```$"
LANGUAGE_TAG = r"(?i)^\s*language\s+[A-Za-z\x{4e00}-\x{9fff}_-]+\s*"


def map_language(code: Column) -> Column:
    """A canonical language name for a code or name, else N/A."""
    key = F.lower(strip(text_or_empty(code)))
    names = {**LANGUAGES, **{n.lower(): n for n in LANGUAGES.values()}}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit("N/A"))


def strict_language(name: Column) -> Column:
    """The name if it is canonical, else N/A."""
    return F.when(name.isin(*sorted(set(LANGUAGES.values()))), name).otherwise(F.lit("N/A"))


def normalize_mode(mode: Column, default: str = "ser") -> Column:
    key = F.lower(strip(text_or_empty(mode)))
    return F.when(key.isin(*MODES), key).otherwise(F.lit(default))


def optional(value: Column) -> Column:
    """Trimmed, with words for nothing as null."""
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(F.lower(text).isin(*NOTHING), F.lit(None)).otherwise(text)


def bare_transcript(text: Column) -> Column:
    """Without the language tags that some models put in front: one that ends in a marker, then one that ends in a colon, a dash or nothing."""
    for end in ("<asr_text>", "[:：-]?"):
        text = F.regexp_replace(strip(text), rf"{LANGUAGE_TAG}{end}\s*", "")
    return strip(text)


def labelled(label: str) -> str:
    return rf"(?:\A|\n)\s*{label}\s*:\s*"


def after(text: Column, label: str) -> Column:
    """What follows the first line that begins with a label; null without one."""
    return F.when(text.rlike(f"(?i){labelled(label)}"), F.regexp_replace(text, rf"(?is)\A.*?{labelled(label)}", ""))


def before(text: Column, labels: str) -> Column:
    """What precedes the first later line that begins with one of some labels."""
    return F.regexp_replace(text, rf"(?is)(?<=.)\n\s*(?:{labels})\s*:.*", "")


def parse_transcript(raw: Column) -> Column:
    """struct(transcription, reported_hotwords, raw_text, detected_language) of lines ``Language:``, ``Hotwords:``, ``Transcription:``.

    A transcript that comes before the hotwords ends there, one that comes after them goes to the end. Line feeds
    may be written as escapes.
    """

    def fields(whole: Column, text: Column) -> Column:
        words, said = after(text, "hotwords"), after(text, "transcription")
        # a label counts anywhere in a line when it comes to which is first
        there = {k: text.rlike(rf"(?i){k}\s*:") for k in ("hotwords", "transcription")}
        ahead = {k: F.char_length(F.regexp_extract(text, rf"(?is)\A(.*?){k}\s*:", 1)) for k in there}
        words_first = there["hotwords"] & (ahead["hotwords"] < ahead["transcription"])
        body = F.when(~there["transcription"], text).when(words_first, F.coalesce(said, F.lit(""))).otherwise(F.coalesce(F.nullif(before(said, "hotwords"), F.lit("")), text))
        return F.struct(
            bare_transcript(body).alias("transcription"), parse_list(before(words, "language|transcription")).alias("reported_hotwords"), whole.alias("raw_text"),
            optional(F.substring_index(after(text, "language"), "\n", 1)).alias("detected_language"),
        )

    lines = lambda whole: F.replace(F.replace(whole, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    return let(strip(text_or_empty(raw)), lambda whole: let(lines(whole), lambda text: fields(whole, text)))


def unfence(text: Column) -> Column:
    text = strip(text_or_empty(text))
    return F.when(text.rlike(FENCE), strip(F.regexp_extract(text, FENCE, 1))).otherwise(text)


def match_emotion(text: Column) -> Column:
    """The label that a text is, punctuation aside, else the first label whose name is a word of it, else empty."""
    # every label's first word is among these, so one look tells most texts that name none
    names = "|".join(name.lower().split("/")[0] for name in EMOTIONS)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.when(low.rlike(rf"(?U)\b(?:{names})\b"), _match_lower(low)).otherwise(""))


def _match_lower(low: Column) -> Column:
    bare = F.regexp_replace(strip(low), r"""[.,!?;:"'\s]+$""", "")
    label = F.lit("")
    for name in reversed(EMOTIONS):
        label = F.when(low.rlike(rf"(?U)\b{name.lower().split('/')[0]}\b"), F.lit(name)).otherwise(label)
    for name in EMOTIONS:
        label = F.when(bare == name.lower(), F.lit(name)).otherwise(label)
    return label


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_strings(text: pd.Series) -> pd.Series:
    """The string members of a JSON object; a JSON string under the empty key; null for what isn't JSON."""

    def one(x: str | None) -> dict | None:
        try:
            value = json.loads(x) if x else None
        except ValueError:
            return None
        if isinstance(value, str):
            return {"": value}
        return {k: v for k, v in value.items() if isinstance(v, str)} if isinstance(value, dict) else None

    return text.map(one)


def parse_emotion_label(raw: Column) -> Column:
    """struct(label, text): one label of the taxonomy, from plain text or from JSON."""
    text = unfence(raw)
    direct, members = match_emotion(text), json_strings(text)
    found = [F.nullif(match_emotion(F.try_element_at(members, F.lit(k))), F.lit("")) for k in (*LABEL_KEYS, "")]
    label = F.coalesce(F.nullif(direct, F.lit("")), *found, F.lit(""))
    return F.struct(label.alias("label"), label.alias("text"))


def parse_emotion_summary(raw: Column) -> Column:
    """struct(label, text): a description, from plain text or from JSON, and the label that it mentions."""
    text = unfence(raw)
    members = json_strings(text)
    parts = [F.nullif(strip(F.try_element_at(members, F.lit(k))), F.lit("")) for k in SUMMARY_KEYS]
    summary = F.coalesce(*parts, strip(F.try_element_at(members, F.lit(""))), text)
    return F.struct(match_emotion(summary).alias("label"), summary.alias("text"))


def parse_emotion(raw: Column, mode: Column) -> Column:
    """struct(label, text) by mode; a blank answer has neither."""
    blank = strip(text_or_empty(raw)) == ""
    none = F.struct(F.lit("").alias("label"), F.lit("").alias("text"))
    return F.when(blank, none).when(normalize_mode(mode) == "sec", parse_emotion_summary(raw)).otherwise(parse_emotion_label(raw))


def _hotwords_of(raw: str | None) -> list[str]:
    """Hotwords of an answer that should be a JSON object and may be a list in JSON or plain text."""
    text = (raw or "").strip()
    fenced = re.match(FENCE, text)
    text = fenced[1].strip() if fenced else text

    def members(value) -> list[str] | None:
        held = value.get("hotwords", []) if isinstance(value, dict) else None
        return list(dict.fromkeys(w.strip() for w in held if isinstance(w, str) and w.strip())) if isinstance(held, list) else None

    def entries(value) -> list[str] | None:
        return [w.strip() for w in value if isinstance(w, str) and w.strip()] if isinstance(value, list) else None

    for opening, closing, read in (("", "", members), ("{", "}", members), ("[", "]", entries)):
        a, b = (text.find(opening), text.rfind(closing) + 1) if opening else (0, len(text))
        if a < 0 or b <= a:
            continue
        try:
            words = read(json.loads(text[a:b]))
        except ValueError:
            continue
        if words is not None:
            return words
    plain = (w.strip().strip("\"'") for w in re.split(r"[,，\n;；]+", text))
    return list(dict.fromkeys(w for w in plain if w and not w.startswith("{")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_hotword_answer(raw: pd.Series) -> pd.Series:
    return raw.map(_hotwords_of)


def content_text(content: Column) -> Column:
    """Text of a chat content: a JSON list of parts has its parts' texts on lines, anything else is itself."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = strip(F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != "")), "\n"))
    return F.when(strip(text_or_empty(content)).startswith("[") & parts.isNotNull(), joined).otherwise(text_or_empty(content))

"""Messages to clients and requests to models, as structs and JSON. Absent members are null, and to_json leaves them out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.functions.text import strip, text_or_empty

#: What the models are asked.
TRANSCRIBE = "Transcribe the following audio."
ENROLL, TRANSCRIBE_TARGET = "Given the speaker's voice:", "Transcribe what this speaker says in the following audio:"
TARGET_TASK = "tsasr"
EMOTION_PROMPTS = {"ser": "Classify the emotion of the following audio:", "sec": "Describe the emotion of the following audio:"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def one_decimal(x: Column) -> Column:
    """A number of 0 or more with one decimal, as exact rounding gives it: of the binary value, ties to even.

    The sign of ``side`` is right even where x lies next to the middle of two tenths: its terms cancel without an error.
    """
    tenth = F.floor(x * 10)
    side = (x * 16 - (2 * tenth + 1)) + x * 4
    near = tenth + F.when((side > 0) | ((side == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(near / 10).cast("string"), F.lit("."), (near % 10).cast("string"))


def final(text: Column, language: Column) -> Column:
    return F.to_json(F.struct(F.lit("final").alias("type"), text.alias("text"), language.alias("language")))


def partial(text: Column, language: Column, *, target: bool = False) -> Column:
    task = [F.lit(TARGET_TASK).alias("task")] if target else []
    return F.to_json(F.struct(F.lit("partial").alias("type"), text.alias("text"), language.alias("language"), *task))


def partial_transcript(utterance: Column, text: Column, seq: Column) -> Column:
    return F.to_json(F.struct(F.lit("partial_transcript").alias("type"), utterance.alias("utterance_id"), text.alias("text"), seq.alias("seq")))


def terminator(task: Column, language: Column, mode: Column, streaming: Column) -> Column:
    """The empty message that ends a session without output, by task; segmented emotion sessions end without one."""
    kind, text = F.lit("final").alias("type"), F.lit("").alias("text")
    emotion = F.to_json(F.struct(F.lit("final_emotion").alias("type"), mode.alias("mode"), F.lit("").alias("label"), text, F.lit(0.0).alias("duration_sec"), blank_to_null(language).alias("language")))
    target = F.to_json(F.struct(kind, text, language.alias("language"), F.lit(TARGET_TASK).alias("task")))
    return F.when(task == "emotion", F.when(~streaming, emotion)).when(task == TARGET_TASK, target).otherwise(final(F.lit(""), language))


def upload_final(text: Column, language: Column, seconds: Column) -> Column:
    return F.to_json(F.struct(F.lit("final").alias("type"), text.alias("text"), language.alias("language"), F.round(seconds, 3).alias("duration_sec")))


def target_upload(text: Column, language: Column, seconds: Column, audio: Column) -> Column:
    return F.to_json(F.struct(F.lit("final").alias("type"), F.lit(TARGET_TASK).alias("task"), text.alias("text"), language.alias("language"), F.round(seconds, 3).alias("duration_sec"), audio.alias("audio_b64")))


def error(segment: Column, message: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("type"), segment.alias("id"), message.alias("message")))


def enrollment_error(code: Column) -> Column:
    """Why a session can't begin; the text that goes with a code is the client's."""
    return F.to_json(F.struct(F.lit("error").alias("type"), F.concat(F.lit("enrollment_"), code).alias("code")))


def refused_enrollment(code: Column) -> Column:
    return F.to_json(F.struct(F.concat(F.lit("enrollment_"), code).alias("code")))


def target_final(session: Column, ordinal: Column, text: Column, language: Column, audio: Column, seconds: Column) -> Column:
    tag = F.substring(F.md5(session.cast("string").cast("binary")), 1, 8)
    return F.to_json(F.struct(F.lit("final").alias("type"), F.concat(F.lit("tsasr-"), tag, F.lit("-"), ordinal.cast("string")).alias("id"), text.alias("text"), language.alias("language"), F.lit(TARGET_TASK).alias("task"), audio.alias("audio_b64"), F.round(seconds, 2).alias("duration_sec")))


def emotion_final(mode: Column, label: Column, text: Column, raw: Column, language: Column, seconds: Column) -> Column:
    shown = F.when((text_or_empty(raw) != "") & (raw != text), raw)
    return F.to_json(F.struct(F.lit("final_emotion").alias("type"), mode.alias("mode"), label.alias("label"), text.alias("text"), shown.alias("raw_text"), blank_to_null(language).alias("language"), F.round(seconds, 3).alias("duration_sec")))


def vad_event(segment: Column, seconds: Column, audio: Column) -> Column:
    return F.to_json(F.struct(F.lit("vad_event").alias("type"), F.lit("segment_detected").alias("event"), segment.alias("id"), F.concat(one_decimal(seconds), F.lit("s")).alias("duration"), audio.alias("audio_b64")))


def response(segment: Column, text: Column, hotwords: Column, detected: Column, debug: dict[str, Column] | None = None, emotion: Column | None = None) -> Column:
    """``debug`` has both hypotheses' texts and how they were fused: text_primary, text_secondary, fusion_meta."""
    parts = [F.lit("response").alias("type"), segment.alias("id"), text.alias("text"), hotwords.alias("model_hotwords"), blank_to_null(detected).alias("src_lang_detected")]
    parts += [debug[n].alias(n) for n in ("text_primary", "text_secondary", "fusion_meta")] if debug is not None else []
    parts += [emotion.alias("emotion")] if emotion is not None else []
    return F.to_json(F.struct(*parts))


def primary_prompt(language: Column, hotwords: Column) -> Column:
    return F.concat(F.lit(f"{TRANSCRIBE}\nLanguage: "), language, F.lit("\nHotwords: "), F.array_join(hotwords, ","))


def hotwords_part(hotwords: Column) -> Column:
    words = F.filter(F.transform(F.coalesce(hotwords, F.array().cast("array<string>")), strip), lambda w: w != "")
    return F.when(F.size(words) > 0, F.concat(F.lit("\nHotwords: "), F.array_join(words, ","), F.lit("."))).otherwise("")


def traits_part(traits: Column) -> Column:
    text = strip(text_or_empty(traits))
    return F.when(text == "", "").otherwise(F.concat(F.lit("\nSpeaker traits: "), text, F.when(text.rlike(r"[.!?]$"), "").otherwise(".")))


def target_content(enrollment: Column, mixed: Column, hotwords: Column, traits: Column) -> Column:
    """Parts of the request: enrollment, what is known of the speaker, and the mixed audio last."""

    def said(x: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), x.alias("text"), F.lit(None).cast("struct<data:string,format:string>").alias("input_audio"))

    def heard(x: Column) -> Column:
        return F.struct(F.lit("input_audio").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(x.alias("data"), F.lit("wav").alias("format")).alias("input_audio"))

    every = F.array(said(F.lit(ENROLL)), heard(enrollment), said(traits_part(traits)), said(hotwords_part(hotwords)), said(F.lit("\n" + TRANSCRIBE_TARGET)), heard(mixed))
    return F.filter(every, lambda x: (x["type"] != "text") | (x["text"] != ""))


def extract_endpoint(base: Column) -> Column:
    bare = F.regexp_replace(base, "/+$", "")
    return F.when(bare.endswith("/chat/completions"), bare).otherwise(F.concat(bare, F.lit("/chat/completions")))


def endpoint(own: Column, shared: Column) -> Column:
    """A task's own model server, else the shared one."""
    return F.coalesce(blank_to_null(own), shared)

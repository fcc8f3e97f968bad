"""Speech tasks as functions of DataFrames, with the models' answers as functions that the user passes in.

A model is a function of clips (key, pcm, ...) to rows with the same key and what it answers. It may call a service in
``mapInPandas``, or join a table of answers that are there already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.functions.text import strip, text_or_empty
from sonoframe.operators import fusion, messages, session, vad
from sonoframe.params import Params
from sonoframe.sources.audio import enrollments as decode_enrollments
from sonoframe.sources.audio import validate_uploads
from sonoframe.sources.scratch import stored

Model = Callable[[DataFrame], DataFrame]

#: Statuses of uploads that have no result.
REFUSED = 400
STATUS = {"empty": 400, "too_large": 413, "decode_failed": 400, "empty_audio": 400, "failed": 502}


class Task:
    """A task's parts; what it doesn't override puts out nothing. Messages are rows (session_id, place, message)."""

    name = "base"

    def final(self, segments: DataFrame) -> DataFrame:
        """Messages for closed segments (session_id, place, segment_id, pcm, language)."""
        return self.nothing(segments)

    def partial(self, snapshots: DataFrame) -> DataFrame:
        """Messages for growing segments, of the same columns."""
        return self.nothing(snapshots)

    def start(self, sessions: DataFrame) -> DataFrame:
        """Messages for sessions that begin; they don't count as output."""
        return self.nothing(sessions)

    def stop(self, sessions: DataFrame, outputs: DataFrame) -> DataFrame:
        """Messages for sessions (session_id, stopped, language) that are over, given what they put out."""
        return self.nothing(sessions)

    @staticmethod
    def nothing(rows: DataFrame) -> DataFrame:
        return rows.select("session_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("message")).where(F.lit(False))


def run(task: Task, segments: DataFrame, *, snapshots: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """All messages of a task: finals, partials, what sessions that can't begin are told, and what silent ones end with."""
    finals = task.final(segments)
    out = finals
    if snapshots is not None:
        out = out.union(task.partial(snapshots))
    return out if sessions is None else out.union(task.start(sessions)).union(task.stop(sessions, finals))


def as_column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def matched(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the clips, by sorting both. Spark guesses what Python makes of a table, and stored sound that compresses well, far too small, and would send it whole to every executor."""
    return left.join(right.hint("merge"), key, how)


def ended(task: str, sessions: DataFrame, outputs: DataFrame, mode: str = "ser", streaming: bool = False) -> DataFrame:
    known = sessions.select("session_id", "stopped", "language", F.lit(task).alias("task"), F.lit(mode).alias("mode"), F.lit(streaming).alias("streaming"))
    return session.terminators(known, outputs, "session_id").select("session_id", F.lit(None).cast("long").alias("place"), "message")


def transcribed(clips: DataFrame, key: str, primary: Model | None, secondary: Model | None, params: Params, hotwords: Column | None, similarity: Column | None = None) -> DataFrame:
    """``clips`` with ``final``, its text, ``detected``, the primary model's language, and ``second``, whether the secondary model heard anything; clips that no model answered go."""
    none = clips.select(key, F.lit("").alias("text"), F.lit("").alias("detected_language")).where(F.lit(False))
    first, second = (none if model is None else model(clips) for model in (primary, secondary))
    pairs = fusion.pair_hypotheses(first, second, key)
    second_heard = strip(text_or_empty("secondary_text")) != ""
    texts = fusion.final_text(pairs, params, hotwords=hotwords, similarity=similarity).select(key, strip(F.col("final")).alias("final"), second_heard.alias("second"))
    return matched(matched(clips, texts, key), first.select(key, F.col("detected_language").alias("detected")), key, "left")


class Transcription(Task):
    """Two models' hypotheses of each segment, fused. Where the secondary model hears nothing there is no message."""

    name = "asr"

    def __init__(self, primary: Model | None, secondary: Model | None, params: Params = Params(), *, hotwords: Column | None = None, similarity: Column | None = None):
        self.primary, self.secondary, self.params, self.how = primary, secondary, params, (hotwords, similarity)

    def spoken(self, clips: DataFrame) -> DataFrame:
        return transcribed(clips, "segment_id", self.primary, self.secondary, self.params, *self.how).where(F.col("final") != "")

    def final(self, segments: DataFrame) -> DataFrame:
        message = messages.final(F.col("final"), fusion.detected_or(F.col("detected"), F.col("language")))
        return self.spoken(segments).select("session_id", "place", message.alias("message"))

    def partial(self, snapshots: DataFrame) -> DataFrame:
        said = self.spoken(snapshots)
        if self.secondary is not None:
            said = said.where("second")
        return said.select("session_id", "place", messages.partial(F.col("final"), F.col("language")).alias("message"))

    def stop(self, sessions: DataFrame, outputs: DataFrame) -> DataFrame:
        return ended(self.name, sessions, outputs)


class TargetTranscription(Task):
    """What one enrolled speaker says. Sessions without a usable enrollment put out nothing but why and their end.

    ``enrollments`` is (session_id, pcm[, error, voice_traits]), as sources.enrollments() gives it. Segments with too
    little voice never reach the model. It gets, beside the clip, the ``enrollment``, the speaker's ``voice_traits``,
    and the ``hotwords`` that hold for the segment, where the tables have them.
    """

    name = messages.TARGET_TASK

    def __init__(self, model: Model, enrollments: DataFrame, params: Params = Params()):
        self.model, self.enrollments, self.params = model, enrollments, params

    def final(self, segments: DataFrame) -> DataFrame:
        clips = segments.withColumn("pcm", au.tail_cap_pcm(F.col("pcm"), self.params.target_max_sec))
        known = session.with_enrollment(gated(clips, self.params), self.usable(), "session_id")
        said = matched(known, self.model(known).select("segment_id", strip(text_or_empty("text")).alias("text"), "detected_language"), "segment_id")
        said = session.numbered_outputs(said, "session_id", ["place"])
        language = fusion.detected_or(F.col("detected_language"), F.col("language"))
        message = messages.target_final(F.col("session_id"), F.col("ordinal"), F.col("text"), language, F.base64(au.encode_wav("pcm")), F.octet_length("pcm") / (2 * au.RATE))
        return said.select("session_id", "place", message.alias("message"))

    def usable(self) -> DataFrame:
        good = self.enrollments.where("error IS NULL") if "error" in self.enrollments.columns else self.enrollments
        traits = [c for c in ("voice_traits",) if c in good.columns]
        return good.select("session_id", F.col("pcm").alias("enrollment"), *traits)

    def start(self, sessions: DataFrame) -> DataFrame:
        if "error" not in self.enrollments.columns:
            return self.nothing(sessions)
        told = sessions.join(self.enrollments.where("error IS NOT NULL").select("session_id", "error"), "session_id")
        return told.select("session_id", F.lit(None).cast("long").alias("place"), messages.enrollment_error(F.col("error")).alias("message"))

    def stop(self, sessions: DataFrame, outputs: DataFrame) -> DataFrame:
        return ended(self.name, sessions, outputs)


def gated(clips: DataFrame, params: Params) -> DataFrame:
    """Clips (pcm) with as much voice as the gate asks for."""
    if not params.gate_enabled or params.gate_min_voiced_ms <= 0:
        return clips
    return clips.where(vad.passes_gate(vad.voiced_seconds(vad.Rules.of(params), params)("pcm"), params))


class Emotion(Task):
    """A label or a description of each clip. Whole utterances promise one message a session, segments don't."""

    name = "emotion"

    def __init__(self, model: Model, mode: str = "ser", *, streaming: bool = False, params: Params = Params()):
        self.model, self.mode, self.streaming, self.params = model, mode, streaming, params

    def final(self, segments: DataFrame) -> DataFrame:
        clips = segments.withColumn("pcm", au.tail_cap_pcm(F.col("pcm"), self.params.emotion_max_sec))
        found = matched(clips, self.model(clips).select("segment_id", "label", "text", "raw_text"), "segment_id")
        message = messages.emotion_final(F.lit(self.mode), F.col("label"), F.col("text"), F.col("raw_text"), F.col("language"), F.octet_length("pcm") / (2 * au.RATE))
        return found.select("session_id", "place", message.alias("message"))

    def stop(self, sessions: DataFrame, outputs: DataFrame) -> DataFrame:
        return ended(self.name, sessions, outputs, self.mode, self.streaming)


def uploaded(files: DataFrame, answer: Callable[[DataFrame], DataFrame], params: Params = Params()) -> DataFrame:
    """(path, status, message) of each file: ``answer`` maps readable clips to (path, message[, refused]), where ``refused`` says that the message tells why there is no result; the others, and those without an answer, have a status only.

    Files are decoded once: all models and branches read the stored clips.
    """
    clips = stored(validate_uploads(files, params), "clips")
    good = clips.where("error IS NULL")
    answers = answer(good)
    both = matched(clips.select("path", "error"), answers, "path", "left")
    error = F.coalesce("error", F.when(F.col("message").isNull(), "failed"))
    done = F.when(F.col("refused"), F.lit(REFUSED)).otherwise(F.lit(200)) if "refused" in answers.columns else F.lit(200)
    status = F.coalesce(*[F.when(error == name, F.lit(code)) for name, code in STATUS.items()], done)
    return both.select("path", status.alias("status"), "message")


def transcribe_uploads(files: DataFrame, primary: Model | None, secondary: Model | None, params: Params = Params(), *, language: Column | str = "", hotwords: Column | None = None, similarity: Column | None = None) -> DataFrame:
    """Uploaded files, decoded, capped, and transcribed by two models: (path, status, message). A silent clip has an empty text."""

    def answer(clips: DataFrame) -> DataFrame:
        said = transcribed(clips, "path", primary, secondary, params, hotwords, similarity)
        return said.select("path", messages.upload_final(F.col("final"), fusion.detected_or(F.col("detected"), as_column(language)), F.col("seconds")).alias("message"))

    return uploaded(files, answer, params)


def emotion_of_uploads(files: DataFrame, model: Model, mode: str = "ser", params: Params = Params(), *, language: Column | str = "") -> DataFrame:
    """Uploaded files and one label or description of each: (path, status, message)."""

    def answer(clips: DataFrame) -> DataFrame:
        found = matched(clips, model(clips).select("path", "label", "text", "raw_text"), "path")
        return found.select("path", messages.emotion_final(F.lit(mode), F.col("label"), F.col("text"), F.col("raw_text"), as_column(language), F.col("seconds")).alias("message"))

    return uploaded(files, answer, params.override({"upload_max_sec": params.emotion_max_sec}))


def target_uploads(files: DataFrame, model: Model, enrollments: DataFrame, params: Params = Params(), *, language: Column | str = "") -> DataFrame:
    """Uploaded files and what the enrolled speaker of each says there: (path, status, message).

    ``enrollments`` is (path, audio_b64[, format, voice_traits]), as sent. A readable file whose enrollment is missing or
    can't be used is refused with its code, and no model is asked. The model gets the decoded ``enrollment`` and the traits.
    """
    sent = enrollments.withColumnRenamed("path", "session_id")
    if "format" not in sent.columns:
        sent = sent.withColumn("format", F.lit("wav"))
    decoded = decode_enrollments(sent, params).select(F.col("session_id").alias("path"), F.col("pcm").alias("enrollment"), F.when(F.col("pcm").isNull(), F.coalesce("error", F.lit("missing"))).alias("refused"))
    if "voice_traits" in enrollments.columns:
        decoded = matched(decoded, enrollments.select("path", "voice_traits"), "path")
    # decoded once, like the files: what is told and what the model is asked both read it
    decoded = stored(decoded.withColumn("sent", F.lit(True)), "enrollments")

    def answer(clips: DataFrame) -> DataFrame:
        # a file is looked at first, its enrollment next; only what passes both reaches the model
        asked = matched(clips, decoded, "path", "left").withColumn("refused", F.when(F.col("sent"), F.col("refused")).otherwise("missing")).drop("sent")
        known = asked.where("refused IS NULL").drop("refused")
        said = matched(known, model(known).select("path", strip(text_or_empty("text")).alias("text"), "detected_language"), "path")
        message = messages.target_upload(F.col("text"), fusion.detected_or(F.col("detected_language"), as_column(language)), F.col("seconds"), F.base64(au.encode_wav("pcm")))
        told = asked.where("refused IS NOT NULL").select("path", messages.refused_enrollment(F.col("refused")).alias("message"), F.lit(True).alias("refused"))
        return said.select("path", message.alias("message"), F.lit(False).alias("refused")).union(told)

    return uploaded(files, answer, params.override({"upload_max_sec": params.target_max_sec}))

"""A live task as one stream, from bytes to the messages that clients get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.functions.text import strip
from sonoframe.operators import messages
from sonoframe.operators.vad import Rules
from sonoframe.params import Params
from sonoframe.streaming.live_session import Respond, live_sessions


def live_messages(rows: DataFrame, task: str, respond: Respond, params: Params = Params(), *, rules: Rules | None = None, mode: str = "ser", partials: bool = True, language: str = "", late: str | None = None, **how) -> DataFrame:
    """(session_id, epoch, seg_seq, kind, message): finals, partials and ends of a stream of sessions.

    ``respond`` is the task's model, or models with their fusion: bytes, the controls that hold and whether the
    segment is final, to text. It is called in the task that holds the session, so its calls for a session are in
    order, one at a time. ``task`` is asr, tsasr or emotion; segmented emotion sessions end without a message.
    ``language`` is what sessions speak that don't say.
    """
    every = live_sessions(rows, rules or Rules.of(params), params, respond=respond, partial_ms=params.partial_interval_ms if partials and task != "emotion" else 0, ends=task != "emotion", late=late, **how)
    spoken, said = F.coalesce(F.nullif("language", F.lit("")), F.lit(language)), strip(F.coalesce("text", F.lit("")))
    seconds = F.octet_length("pcm") / (2 * au.RATE)
    target = task == messages.TARGET_TASK
    if task == "emotion":
        final = messages.emotion_final(F.lit(mode), said, said, said, spoken, seconds)
    elif target:
        final = messages.target_final(F.col("session_id"), F.col("seg_seq") + 1, said, spoken, F.base64(au.encode_wav("pcm")), seconds)
    else:
        final = messages.final(said, spoken)
    end = messages.terminator(F.lit(task), spoken, F.lit(mode), F.lit(True))
    message = F.when(F.col("kind") == "final", final).when(F.col("kind") == "partial", messages.partial(said, spoken, target=target)).otherwise(end)
    return every.select("session_id", "epoch", "seg_seq", "kind", message.alias("message"))

"""Speech segments, whole utterances and resampled sound of live sessions, with state kept by Structured Streaming.

A session's rows may come in any order within a micro-batch; they are taken in order of ``seq``. Their ``kind`` is
start, frame, control or stop. A row of kind ``stop``, or no row for the timeout, ends a session; what comes after a
stop is ignored until the timeout forgets the session. A session's rows meet in one task, as their order demands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonoframe.functions import audio as au
from sonoframe.operators.vad import Machine, Rules

FRAME_COLUMNS = ("session_id", "seq", "kind", "prob")
LIVE = "session_id string, kind string, seg_seq long, start_frame long, end_frame long, is_flush boolean, utterance long, hotwords array<string>, language string"
#: A machine's members, then segments so far, utterances so far, the last partial's frame, whether started and over, and the controls as JSON.
STATE = "average double, speaking boolean, count long, quiet long, held long, start long, idx long, segments long, utterances long, partial_at long, started boolean, over boolean, controls string"
UTTERANCE = "session_id string, n_frames long, pcm binary"
DECIMATED = "session_id string, seq long, pcm binary"
DECIMATOR = "history binary, rest binary"


def live_stream(frames: DataFrame, rules: Rules, *, need_start: bool = False, partial_frames: int = 0, least_frames: int = 1, timeout_ms: int = 600_000) -> DataFrame:
    """Closed and growing segments of a stream of (session_id, seq, kind, prob[, control]).

    With ``need_start``, frames and controls before a session's first start are ignored; later starts always are.
    ``control`` is a JSON object of a start or control row: its ``hotwords`` and ``language`` hold from there on, and
    each segment carries those that held when it closed. ``partial_frames`` above 0 also gives the open segment so
    far, if it has ``least_frames``, at the end of a micro-batch, but not within so many frames of the last one: a
    batch sends one partial a session at most, its newest.
    """
    wanted = frames.select(*FRAME_COLUMNS, F.col("control") if "control" in frames.columns else F.lit(None).cast("string").alias("control"))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, False, 0, 0, 0, 0, -1, 0, 0, None, False, False, "{}")
        machine = Machine(rules, held[0], *held[1:7])
        n, utterances, partial_at, begun, over, controls = *held[7:12], json.loads(held[12])
        out: list[tuple] = []

        def put(kind: str, found: tuple[int, int] | None, flush: bool) -> None:
            nonlocal n
            if found:
                out.append((key[0], kind, n, *found, flush, utterances, controls.get("hotwords"), controls.get("language")))
                n += kind == "final"

        if state.hasTimedOut:
            if not over:
                put("final", machine.flush(), True)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for kind, p, control in zip(rows["kind"].tolist(), rows["prob"].fillna(0.0).tolist(), rows["control"].tolist(), strict=True):
                if over or (kind == "start" and begun) or (need_start and not begun and kind != "start"):
                    continue
                if kind == "stop":
                    put("final", machine.flush(), True)
                    over = True
                elif kind == "frame":
                    spoke = machine.speaking
                    found = machine.step(p)
                    utterances += machine.speaking and not spoke
                    put("final", found, False)
                else:
                    begun = begun or kind == "start"
                    controls |= {k: v for k, v in as_object(control).items() if k in ("hotwords", "language")}
            if partial_frames and not over and machine.speaking and machine.index - machine.start + 1 >= least_frames and (partial_at is None or machine.index - partial_at >= partial_frames):
                partial_at = machine.index
                put("partial", (machine.start, machine.index), False)
            state.update((machine.average, machine.speaking, machine.count, machine.quiet, machine.held, machine.start, machine.index, n, utterances, partial_at, begun, over, json.dumps(controls)))
            state.setTimeoutDuration(timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "kind", "seg_seq", "start_frame", "end_frame", "is_flush", "utterance", "hotwords", "language"])

    return wanted.groupBy("session_id").applyInPandasWithState(advance, LIVE, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def as_object(control: str | None) -> dict:
    """A JSON object, or nothing for what isn't one."""
    try:
        found = json.loads(control) if control else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def segment_stream(frames: DataFrame, rules: Rules, *, timeout_ms: int = 600_000, need_start: bool = False) -> DataFrame:
    """Closed segments of a stream of (session_id, seq, kind, prob)."""
    return live_stream(frames, rules, need_start=need_start, timeout_ms=timeout_ms).select("session_id", "seg_seq", "start_frame", "end_frame", "is_flush")


def utterance_stream(frames: DataFrame, *, most_seconds: float = 20.0, timeout_ms: int = 600_000) -> DataFrame:
    """(session_id, n_frames, pcm): one row a session, when it stops or times out, with the last ``most_seconds`` of its 16-bit payloads.

    Frames are (session_id, seq, kind[, payload]); without payloads ``pcm`` is empty.
    """
    most = 2 * int(au.RATE * most_seconds)
    wanted = frames.select("session_id", "seq", "kind", F.col("payload") if "payload" in frames.columns else F.lit(b"").alias("payload"))

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, pcm, over = state.get if state.exists else (0, b"", False)
        done = state.hasTimedOut and not over
        if state.hasTimedOut:
            state.remove()
        else:
            if not over:
                rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
                kinds = rows["kind"].tolist()
                done = over = "stop" in kinds
                upto = kinds.index("stop") if over else len(kinds)
                sound = [bytes(x or b"") for x, k in zip(rows["payload"].tolist()[:upto], kinds, strict=False) if k == "frame"]
                n, pcm = n + len(sound), (bytes(pcm) + b"".join(sound))[-most:]
            state.update((n, b"" if over else pcm, over))
            state.setTimeoutDuration(timeout_ms)
        if done:
            yield pd.DataFrame({"session_id": [key[0]], "n_frames": [n], "pcm": [bytes(pcm)]})

    return wanted.groupBy("session_id").applyInPandasWithState(gather, UTTERANCE, "n long, pcm binary, over boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def decimate_stream(frames: DataFrame, cutoff: float = au.CUTOFF, *, timeout_ms: int = 600_000) -> DataFrame:
    """(session_id, seq, pcm) at 16 kHz of 48 kHz 16-bit payloads; chunk borders leave no trace. A session without rows for the timeout is forgotten."""

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        line = au.Decimator(cutoff, tuple(map(bytes, state.get)) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = [(key[0], s, au.to_pcm16(line.feed(au.pcm16(bytes(p))))) for s, p in zip(rows["seq"].tolist(), rows["payload"].tolist(), strict=True)]
        state.update(line.state)
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["session_id", "seq", "pcm"])

    return frames.select("session_id", "seq", "payload").groupBy("session_id").applyInPandasWithState(feed, DECIMATED, DECIMATOR, "append", GroupStateTimeout.ProcessingTimeTimeout)

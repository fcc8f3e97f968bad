"""Live sessions from bytes to messages, as one stateful operator.

Rows are (session_id, seq, at, kind, payload, body). They may come in any order and more than once, over any
micro-batches: a row waits in state until all before it have come, ``seq`` counting from 0 without gaps, and a timer
gives a gap up. ``kind`` is start, frame, control or stop; frames bring bytes that may be cut anywhere.

State by session: a detector's numbers with the bytes that don't fill a frame yet and the ring of frames before
speech, in one value; the open segment's bytes in a list, dropped when it closes; waiting rows in a map. What a task
holds follows its sessions' open segments, not their length.

Out come, in one stream, closed segments (``final``), growing ones (``partial``), and an ``end`` for a session that
was stopped and had put out nothing. A session that is silent for the timeout is taken for disconnected: its open
segment is closed, no end follows, and its state goes; if it speaks again that is another ``epoch``, which is the
time of its first row, so that (session_id, epoch, seg_seq) is never given twice.

Time is the rows' ``at`` with a watermark, or the clock of the cluster. Rows behind the watermark are dropped by
Spark, before they get here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonoframe.operators.streams import Detector, Heard, SegmentStream, by_energy
from sonoframe.operators.vad import Machine, Rules
from sonoframe.params import Params
from sonoframe.streaming.vad_stream import as_object

OUT = "session_id string, epoch long, kind string, seg_seq long, start_frame long, end_frame long, is_flush boolean, utterance long, pcm binary, text string, hotwords array<string>, language string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: A machine's members, then those of the segment stream and of the session.
VALUES = (
    "average double, speaking boolean, count long, quiet long, held long, start long, idx long, carry binary, ring binary, segments long, utterances long, "
    "history binary, rest binary, odd binary, "
    "epoch long, now long, next_seq long, partial_at long, begun boolean, over boolean, said long, controls string, gap_due long, idle_due long"
)
#: What a segment says: its text, or nothing; it is called with the bytes, the controls that hold, and whether it is final.
Respond = Callable[[bytes, dict, bool], str | None]


class Sessions(StatefulProcessor):
    """The operator's state machine; see live_sessions() for what its settings mean."""

    def __init__(self, rules: Rules, params: Params, detector: Detector, respond: Respond | None, need_start: bool, partial_ms: int, ends: bool, gap_ms: int, timeout_ms: int, event_time: bool, rate: int):
        self.rules, self.params, self.detector, self.respond = rules, params, detector, respond
        self.need_start, self.partial_ms, self.ends = need_start, partial_ms, ends
        self.gap_ms, self.timeout_ms, self.event_time, self.rate = gap_ms, timeout_ms, event_time, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getValueState("session", VALUES)
        self.open = handle.getListState("open_segment", "pcm binary")
        self.waiting = handle.getMapState("waiting", "seq long", "at long, kind string, payload binary, body string")

    # -- one session's members, for the length of a call

    def load(self, key: str, now: int) -> None:
        v = self.values.get() if self.values.exists() else (None, False, 0, 0, 0, 0, -1, b"", b"", 0, 0, b"", b"", b"", now, now, 0, None, False, False, 0, "{}", None, None)
        machine = Machine(self.rules, v[0], *v[1:7])
        self.key, self.out = key, []
        self.sound = SegmentStream(self.rules, self.params, self.detector, machine, bytes(v[7]), bytes(v[8]), v[9], v[10], before=lambda: b"".join(bytes(r[0]) for r in self.open.get()), rate=self.rate, line=tuple(map(bytes, v[11:14])))
        self.epoch, self.now, self.next, self.partial_at, self.begun, self.over, self.said = v[14:21]
        self.controls, self.gap_due, self.idle_due = json.loads(v[21]), v[22], v[23]

    def store(self) -> None:
        s, m = self.sound, self.sound.machine
        if not m.speaking:
            self.open.clear()
        elif s.fresh:
            piece = (b"".join(s.fresh),)
            self.open.appendValue(piece) if s.older else self.open.put([piece])
        values = (m.average, m.speaking, m.count, m.quiet, m.held, m.start, m.index, s.carry, s.ring, s.n, s.utterances, *s.line)
        self.values.update((*values, self.epoch, self.now, self.next, self.partial_at, self.begun, self.over, self.said, json.dumps(self.controls), self.gap_due, self.idle_due))

    def due(self, name: str, at: int | None) -> None:
        """Moves a timer."""
        old = getattr(self, name)
        if old == at:
            return
        other = self.idle_due if name == "gap_due" else self.gap_due
        if old is not None and old != other:
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)
        setattr(self, name, at)

    # -- what a session does

    def put(self, kind: str, h: Heard) -> None:
        text = self.respond(h.pcm, self.controls, kind == "final") if self.respond else None
        if self.respond and not (text or "").strip():
            return
        self.said += 1
        self.out.append((self.key, self.epoch, kind, h.seq, h.start, h.end, h.is_flush, self.sound.utterances, h.pcm, text, self.controls.get("hotwords"), self.controls.get("language")))

    def take(self, kind: str, payload: bytes | None, body: str | None) -> None:
        if self.over or (kind == "start" and self.begun) or (self.need_start and not self.begun and kind != "start"):
            return
        if kind == "frame":
            for h in self.sound.feed(bytes(payload or b"")):
                self.put("final", h)
            if self.partial_ms and (self.partial_at is None or self.now - self.partial_at >= self.partial_ms):
                h = self.sound.snapshot()
                if h is not None:
                    self.partial_at = self.now
                    self.put("partial", h)
        elif kind == "stop":
            for h in self.sound.flush():
                self.put("final", h)
            self.over = True
            if self.ends and not self.said:
                self.out.append((self.key, self.epoch, "end", None, None, None, None, None, None, "", self.controls.get("hotwords"), self.controls.get("language")))
        else:
            self.begun = self.begun or kind == "start"
            self.controls |= {k: v for k, v in as_object(body).items() if k in ("hotwords", "language")}

    def drain(self, rows: dict[int, tuple]) -> None:
        """Takes rows, those that waited included, as far as they follow each other; the others wait."""
        kept = dict(rows)
        while True:
            row = kept.pop(self.next, None)
            if row is None:
                if not self.waiting.containsKey((self.next,)):
                    break
                row = self.waiting.getValue((self.next,))
                self.waiting.removeKey((self.next,))
            self.next += 1
            if self.event_time:
                self.now = max(self.now, row[0])
            self.take(*row[1:])
        for seq, row in kept.items():
            self.waiting.updateValue((seq,), row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[int, tuple] = {}
        for part in rows:
            for seq, at, kind, payload, body in zip(part["seq"].tolist(), part["at"].tolist(), part["kind"].tolist(), part["payload"].tolist(), part["body"].tolist(), strict=True):
                came.setdefault(int(seq), (int(at.timestamp() * 1000), kind, None if payload is None else bytes(payload), body))
        latest = max(r[0] for r in came.values()) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        first = min(r[0] for r in came.values()) if self.event_time else latest
        self.load(key[0], first)
        if not self.event_time:
            self.now = latest
        self.drain({s: r for s, r in came.items() if s >= self.next})
        stuck = next(iter(self.waiting.keys()), None) is not None
        self.due("gap_due", (self.gap_due or latest + self.gap_ms) if stuck else None)
        self.due("idle_due", max(latest + self.timeout_ms, self.idle_due or 0))
        self.store()
        yield from self.rows()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.values.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.load(key[0], at)
        if not self.event_time:
            self.now = at
        if at == self.gap_due:
            self.gap_due = None
            self.skip()
            # another gap may lie behind this one
            if next(iter(self.waiting.keys()), None) is not None:
                self.due("gap_due", at + self.gap_ms)
        if at == self.idle_due:
            while next(iter(self.waiting.keys()), None) is not None:
                self.skip()
            if not self.over:
                for h in self.sound.flush():
                    self.put("final", h)
            self.due("gap_due", None)
            self.values.clear()
            self.open.clear()
            self.waiting.clear()
        else:
            self.store()
        yield from self.rows()

    def skip(self) -> None:
        """Gives the missing rows up and goes on with the first that waits."""
        self.next = min(k[0] for k in self.waiting.keys())
        self.drain({})

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.out:
            yield pd.DataFrame(self.out, columns=COLUMNS)

    def close(self) -> None:
        pass


def live_sessions(
    rows: DataFrame,
    rules: Rules,
    params: Params = Params(),
    *,
    detector: Detector = by_energy,
    respond: Respond | None = None,
    need_start: bool = False,
    partial_ms: int = 0,
    ends: bool = True,
    gap_ms: int = 2_000,
    timeout_ms: int = 600_000,
    late: str | None = None,
    rate: int = 16_000,
) -> DataFrame:
    """Segments with their sound, partials and ends of a stream of (session_id, seq, at, kind, payload, body).

    ``respond`` turns a segment into text; without one each segment counts as said. With it, segments without text
    aren't put out. ``partial_ms`` above 0 sends the open segment at most once in so many milliseconds. ``ends`` is
    off for tasks that end without a message. With ``late``, an interval such as "5 seconds", time is that of ``at``
    and its watermark; without it, the cluster's clock. ``rate`` is that of the
    bytes, 16,000 or 48,000. Needs the RocksDB state store.
    """
    wanted = rows.select("session_id", "seq", "at", "kind", "payload", "body")
    if late is not None:
        wanted = wanted.withWatermark("at", late)
    made = Sessions(rules, params, detector, respond, need_start, partial_ms, ends, gap_ms, timeout_ms, late is not None, rate)
    return wanted.groupBy("session_id").transformWithStateInPandas(made, OUT, "append", "EventTime" if late is not None else "ProcessingTime")

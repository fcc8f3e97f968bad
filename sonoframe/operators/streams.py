"""What a task does with a session's bytes as they come: one protocol, a strategy that finds segments, one that keeps whole utterances.

The same objects run in streams, in table functions and in batches, so these can't differ. Bytes are 16-bit samples;
a chunk may end anywhere, what doesn't fill a frame waits for the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.operators.vad import Machine, Rules
from sonoframe.params import Params

#: Frames of samples, a row each, to speech probabilities.
Detector = Callable[[np.ndarray], np.ndarray]
SEGMENT = "seg_seq long, start_frame long, end_frame long, is_flush boolean, pcm binary"


def by_energy(frames: np.ndarray) -> np.ndarray:
    return au.energy_prob(np.sqrt(np.square(frames).mean(axis=1, dtype=np.float32)))


class Heard(NamedTuple):
    """A finished piece of a session. Frames are numbered from 0; ``pcm`` is of the frames from ``start`` to ``end``."""

    seq: int
    start: int
    end: int
    is_flush: bool
    pcm: bytes


class AudioStream(Protocol):
    """Takes a session's bytes in order and gives what they finish."""

    def feed(self, data: bytes) -> list[Heard]: ...

    def flush(self) -> list[Heard]: ...


@dataclass
class SegmentStream:
    """Speech segments. ``before`` gives the bytes of the open segment that an earlier object was fed, where this one continues it.

    Bytes of a ``rate`` of 48,000 are brought to 16,000 first; what the filter needs of the past goes with the object.
    """

    rules: Rules
    params: Params = Params()
    detector: Detector = by_energy
    machine: Machine | None = None
    carry: bytes = b""
    ring: bytes = b""
    n: int = 0
    utterances: int = 0
    before: Callable[[], bytes] = bytes
    rate: int = au.RATE
    #: the filter's history and rest, and the odd byte of a chunk cut within a sample
    line: tuple[bytes, bytes, bytes] = (b"", b"", b"")
    #: bytes of the open segment since this object was made, and whether the segment is older than that
    fresh: list[bytes] = field(default_factory=list)
    older: bool = False

    def __post_init__(self) -> None:
        self.machine = self.machine or Machine(self.rules)
        self.older = self.machine.speaking

    @property
    def size(self) -> int:
        return 2 * self.params.hop

    @property
    def least(self) -> int:
        return 2 * int(self.params.sample_rate * self.params.min_segment_ms / 1000)

    def decimated(self, data: bytes) -> bytes:
        history, rest, odd = self.line
        data = odd + data
        even = len(data) // 2 * 2
        decimator = au.Decimator(state=(history, rest) if history else None)
        out = au.to_pcm16(decimator.feed(au.pcm16(data[:even])))
        self.line = (*decimator.state, data[even:])
        return out

    def feed(self, data: bytes) -> list[Heard]:
        data = self.carry + (self.decimated(data) if self.rate == 3 * au.RATE else data)
        whole = len(data) // self.size * self.size
        self.carry, data = data[whole:], data[:whole]
        if not data:
            return []
        out, machine = [], self.machine
        probs = self.detector(au.pcm16(data).reshape(-1, self.params.hop))
        for i, p in enumerate(np.asarray(probs, np.float64).tolist()):
            frame = data[i * self.size : (i + 1) * self.size]
            was, held = machine.speaking, machine.held
            found = machine.step(p)
            if found:
                self.fresh.append(frame)
                out += self.closed(found, False)
            elif machine.speaking and not was:
                # the segment begins with the frames that led to it
                self.utterances += 1
                kept = min(held + 1, self.rules.ring) - 1
                self.fresh = [self.ring[max(0, len(self.ring) - kept * self.size) :] if kept else b"", frame]
                self.ring = b""
            elif machine.speaking:
                self.fresh.append(frame)
            else:
                self.ring = (self.ring + frame)[-self.rules.ring * self.size :]
        return out

    def snapshot(self) -> Heard | None:
        """The open segment so far, if it is long enough."""
        if not self.machine.speaking or (self.machine.index - self.machine.start + 1) * self.size < self.least:
            return None
        return Heard(self.n, self.machine.start, self.machine.index, False, self.sound())

    def sound(self) -> bytes:
        return (self.before() if self.older else b"") + b"".join(self.fresh)

    def closed(self, found: tuple[int, int], flush: bool) -> list[Heard]:
        pcm = self.sound()[: (found[1] - found[0] + 1) * self.size]
        self.fresh, self.older, self.ring = [], False, b""
        self.n += 1
        return [Heard(self.n - 1, *found, flush, pcm)] if flush or len(pcm) >= self.least else []

    def flush(self) -> list[Heard]:
        """The open segment, whatever its length; bytes that don't fill a frame go."""
        found = self.machine.flush()
        self.carry = b""
        return self.closed(found, True) if found else []


@dataclass
class UtteranceStream:
    """A session as one piece, when it ends: its last ``most_seconds``, all if that isn't positive."""

    params: Params = Params()
    most_seconds: float = 20.0
    held: bytes = b""
    n_bytes: int = 0

    def feed(self, data: bytes) -> list[Heard]:
        most = 2 * int(self.params.sample_rate * self.most_seconds)
        self.n_bytes += len(data)
        self.held = (self.held + data)[-most:] if most > 0 else self.held + data
        return []

    def flush(self) -> list[Heard]:
        pcm, size = self.held, 2 * self.params.hop
        self.held = b""
        return [Heard(0, 0, max(0, -(-self.n_bytes // size) - 1), True, pcm)] if pcm else []


def heard(chunks: DataFrame, make: Callable[[], AudioStream], *, session: str = "session_id", order: list[str] | None = None, payload: str = "payload") -> DataFrame:
    """(session, seg_seq, start_frame, end_frame, is_flush, pcm): the pieces of each session's chunks, in order.

    Sessions are dealt to tasks and sorted there; a task runs along its rows with one session's stream in hand, so
    it holds that session's open piece only. Null payloads are empty.
    """
    order = order or ["seq"]
    dealt = chunks.select(F.col(session).alias("_s"), *order, F.coalesce(F.col(payload), F.lit(b"")).alias("_p")).repartition(F.col("_s")).sortWithinPartitions("_s", *order)
    columns = [session, "seg_seq", "start_frame", "end_frame", "is_flush", "pcm"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stream = None, None
        for batch in batches:
            out: list[tuple] = []
            for s, data in zip(batch["_s"].tolist(), batch["_p"].tolist(), strict=True):
                if stream is None or s != now:
                    out += [(now, *h) for h in stream.flush()] if stream is not None else []
                    now, stream = s, make()
                out += [(s, *h) for h in stream.feed(bytes(data))]
            yield pd.DataFrame(out, columns=columns)
        if stream is not None:
            yield pd.DataFrame([(now, *h) for h in stream.flush()], columns=columns)

    kind = chunks.schema[session].dataType.simpleString()
    return dealt.select("_s", "_p").mapInPandas(run, f"{session} {kind}, {SEGMENT}")

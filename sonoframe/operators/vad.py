"""Speech segments out of frame probabilities, and what is measured, gated and cut of them.

Frames are dealt by session and sorted by their order; each task runs along its sorted rows with one session's state
in hand, so a session of any length takes constant memory. The streaming operator runs the same state machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions import audio as au
from sonoframe.params import Params


@dataclass(frozen=True)
class Rules:
    """The counts, in frames, that open and close a segment."""

    threshold: float
    smoothing: float
    start: int
    end: int
    keep_tail: int
    ring: int

    @staticmethod
    def of(p: Params) -> Rules:
        return Rules(p.speech_threshold, p.smoothing, p.start_frames, p.closing_frames, p.frames(p.keep_tail_ms, 0), p.frames(p.pre_speech_ms))


@dataclass
class Machine:
    """One session's state. ``index`` numbers its frames from 0."""

    rules: Rules
    average: float | None = None
    speaking: bool = False
    count: int = 0
    quiet: int = 0
    held: int = 0
    start: int = 0
    index: int = -1

    def smooth(self, p: float) -> float:
        a = self.rules.smoothing
        self.average = p if self.average is None else a * self.average + (1 - a) * p
        return self.average

    def step(self, p: float) -> tuple[int, int] | None:
        """Takes a frame; first and last frame of the segment that it closes, if it does."""
        r = self.rules
        self.index += 1
        speech = self.smooth(p) > r.threshold
        if not self.speaking:
            self.held = min(self.held + 1, r.ring)
            self.count = self.count + 1 if speech else 0
            if self.count >= r.start:
                self.speaking, self.quiet, self.start = True, 0, self.index - self.held + 1
            return None
        self.quiet = 0 if speech else self.quiet + 1
        if self.quiet < r.end:
            return None
        found = (self.start, self.index - (r.end - min(r.keep_tail, r.end)))
        self.reset()
        return found

    def flush(self) -> tuple[int, int] | None:
        """Ends the session: the open segment, with all its frames."""
        found = (self.start, self.index) if self.speaking else None
        self.reset()
        return found

    def reset(self) -> None:
        self.average, self.speaking, self.count, self.quiet, self.held = None, False, 0, 0, 0


def along(frames: DataFrame, session: str, order: list[str], value: Column, step, finish, schema: T.StructType) -> DataFrame:
    """Runs ``step(state, session, value)`` along each session's frames and ``finish(state, session)`` at its end; both give rows of ``schema``. A state of None begins a session."""
    keyed = frames.select(F.col(session).alias("_s"), *order, value.cast("double").alias("_v")).repartition(F.col("_s")).sortWithinPartitions("_s", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, first = None, None, True
        for batch in batches:
            out: list[tuple] = []
            for s, v in zip(batch["_s"].tolist(), batch["_v"].tolist(), strict=True):
                if first or s != now:
                    if not first:
                        out += finish(state, now)
                    state, now, first = None, s, False
                state, rows = step(state, s, v)
                out += rows
            yield pd.DataFrame(out, columns=schema.fieldNames()) if out else pd.DataFrame({n: [] for n in schema.fieldNames()})
        if not first:
            last = finish(state, now)
            if last:
                yield pd.DataFrame(last, columns=schema.fieldNames())

    return keyed.select("_s", "_v").mapInPandas(run, schema)


def _typed(frames: DataFrame, session: str, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(session, frames.schema[session].dataType), *[T.StructField(n, t) for n, t in fields]])


def segments(frames: DataFrame, rules: Rules, *, session: str = "session_id", order: list[str] | None = None, prob: Column | None = None) -> DataFrame:
    """(session, seg_seq, start_frame, end_frame, is_flush): speech segments; frames are numbered from 0 in each session. A null probability is 0."""
    value = F.coalesce(prob if prob is not None else F.col("prob"), F.lit(0.0))
    schema = _typed(frames, session, ("seg_seq", T.LongType()), ("start_frame", T.LongType()), ("end_frame", T.LongType()), ("is_flush", T.BooleanType()))

    def step(state, s, v):
        machine, n = state or (Machine(rules), 0)
        found = machine.step(v)
        return (machine, n + (found is not None)), [(s, n, *found, False)] if found else []

    def finish(state, s):
        machine, n = state
        found = machine.flush()
        return [(s, n, *found, True)] if found else []

    return along(frames, session, order or ["frame_idx"], value, step, finish, schema)


def smoothed(frames: DataFrame, smoothing: float, *, session: str = "session_id", order: list[str] | None = None, prob: Column | None = None) -> DataFrame:
    """(session, frame_idx, ema): exponential means; ``smoothing`` is the weight of the past."""
    rules = Rules(2.0, smoothing, 1, 1, 0, 1)
    schema = _typed(frames, session, ("frame_idx", T.LongType()), ("ema", T.DoubleType()))

    def step(state, s, v):
        machine = state or Machine(rules)
        machine.index += 1
        return machine, [(s, machine.index, machine.smooth(v))]

    return along(frames, session, order or ["frame_idx"], F.coalesce(prob if prob is not None else F.col("prob"), F.lit(0.0)), step, lambda state, s: [], schema)


def machine_averages(frames: DataFrame, rules: Rules, *, session: str = "session_id", order: list[str] | None = None, prob: Column | None = None) -> DataFrame:
    """(session, frame_idx, smoothed): the machine's mean after each frame; 0 where the frame closed a segment."""
    schema = _typed(frames, session, ("frame_idx", T.LongType()), ("smoothed", T.DoubleType()))

    def step(state, s, v):
        machine = state or Machine(rules)
        machine.step(v)
        return machine, [(s, machine.index, machine.average or 0.0)]

    return along(frames, session, order or ["frame_idx"], F.coalesce(prob if prob is not None else F.col("prob"), F.lit(0.0)), step, lambda state, s: [], schema)


def speech_presence(frames: DataFrame, rules: Rules, threshold: float, frame_sec: float, *, session: str = "session_id", **how) -> DataFrame:
    """(session, total_sec, voiced_sec, mean_prob, voiced_ratio) over whole frames; voiced is strictly over ``threshold``."""
    found = machine_averages(frames, rules, session=session, **how).groupBy(session).agg(F.count("*").alias("n"), F.count_if(F.col("smoothed") > threshold).alias("v"), F.avg("smoothed").alias("mean_prob"))
    return found.select(session, (F.col("n") * frame_sec).alias("total_sec"), (F.col("v") * frame_sec).alias("voiced_sec"), "mean_prob", F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.0).alias("voiced_ratio"))


def voiced_seconds(rules: Rules, p: Params):
    """A UDF: seconds of a clip's whole frames whose mean is over the gate's threshold, by the energy of its samples."""

    @F.pandas_udf("double")
    def seconds(pcm: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> float:
            machine, n = Machine(rules), 0
            for prob in au.energy_prob(au.frame_energy(au.pcm16(bytes(data or b"")), p.hop)).tolist():
                machine.step(prob)
                n += (machine.average or 0.0) > p.gate_threshold
            return n * p.hop / p.sample_rate

        return pcm.map(one)

    return seconds


def passes_gate(voiced_sec: Column, p: Params) -> Column:
    if not p.gate_enabled or p.gate_min_voiced_ms <= 0:
        return F.lit(True)
    return voiced_sec * 1000 >= p.gate_min_voiced_ms


def long_enough(n_samples: Column, is_flush: Column, p: Params) -> Column:
    """Segments cut off by the end of their session pass whatever their length."""
    return is_flush | (n_samples >= int(p.sample_rate * p.min_segment_ms / 1000))


def tail_cap(values: Column, most: int) -> Column:
    """The last ``most`` entries of an array; all of them if the cap isn't positive."""
    return values if most <= 0 else F.when(F.size(values) > most, F.slice(values, -most, most)).otherwise(values)


def head_cap(values: Column, most: int) -> Column:
    return F.slice(values, 1, most)


def tail_cap_rows(rows: DataFrame, session: str, order: list[str], most: int) -> DataFrame:
    """The last ``most`` rows of each session."""
    place = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")


def voiced_trim(found: DataFrame, totals: DataFrame, target: int, *, session: str = "session_id") -> DataFrame:
    """(session, start_frame, end_frame, kept): segments in order until they fill ``target`` frames, the last one cut.

    A session of at most ``target`` frames is kept whole; a longer one without a segment keeps its first ``target``.
    ``totals`` has (session, n_frames).
    """
    so_far = Window.partitionBy(session).orderBy("start_frame").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("end_frame") - F.col("start_frame") + 1
    cut = found.withColumn("_before", F.coalesce(F.sum(size).over(so_far), F.lit(0))).where(F.col("_before") < target)
    cut = cut.select(session, "start_frame", "end_frame", F.least(size, target - F.col("_before")).alias("kept"))
    cut = cut.join(totals.where(F.col("n_frames") > target).select(session), session, "left_semi")
    rest = totals.join(cut.select(session).distinct(), session, "left_anti").where("n_frames > 0")
    whole = F.least(F.col("n_frames"), F.lit(target))
    return cut.union(rest.select(session, F.lit(0).cast("long"), whole - 1, whole))


def pre_speech_ring(frames: DataFrame, session: str, order: list[str], value: str, size: int) -> DataFrame:
    """``frames`` with ``ring``: the last ``size`` values up to each frame, itself included."""
    return frames.withColumn("ring", F.collect_list(value).over(Window.partitionBy(session).orderBy(*order).rowsBetween(-(size - 1), 0)))


def run_counter(frames: DataFrame, session: str, order: list[str], flag: Column) -> DataFrame:
    """``frames`` with ``run``: how many frames in a row, up to this one, have the flag."""
    w = Window.partitionBy(session).orderBy(*order)
    df = frames.withColumn("_f", flag).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    return df.withColumn("run", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(Window.partitionBy(session, "_g").orderBy(*order))).drop("_f", "_g")


def partial_snapshots(frames: DataFrame, found: DataFrame, every: int, least: int, *, session: str = "session_id") -> DataFrame:
    """(session, seg_seq, start_frame, upto_frame): growing snapshots of each segment, one for each ``every`` frames once it has ``least``."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    steps = F.when(n >= least, F.sequence(F.lit(0).cast("long"), F.floor((n - least) / every)))
    return found.select(session, "seg_seq", "start_frame", F.explode(steps).alias("_k")).select(session, "seg_seq", "start_frame", (F.col("start_frame") + least - 1 + F.col("_k") * every).alias("upto_frame"))


def event_rules(**changes) -> Rules:
    """Rules for streams with few frames a session."""
    return replace(Rules(0.5, 0.35, 2, 3, 1, 4), **changes)

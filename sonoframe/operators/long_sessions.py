"""Speech segments of sessions too long for one task: chunks run ahead from a guessed state and are joined at the seams.

A frame's effect on the state fades: the mean forgets at ``smoothing`` a frame, and the other numbers are counts that
any quiet stretch sets back. So a chunk starts some frames early from a fresh state and nearly always arrives at its
first frame in the very state that the chunk before it ends in. Where the two differ in any bit the chunk runs again
from the right state, until all seams fit; the result is that of a run along the whole session, whatever the chunks.
Frames are read once, and once more for the chunks that ran again.

A segment that is open over a seam begins where the last opened one did; that is found over the chunks' summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.operators.vad import Machine, Rules
from sonoframe.sources.scratch import drop, stored

STATE = "struct<average:double,speaking:boolean,count:long,quiet:long,held:long>"
SUMMARY = f"chunk long, entry {STATE}, left {STATE}, carried_end long, opened long, last long, found array<struct<start:long,stop:long>>"


def state_of(m: Machine) -> tuple:
    return m.average, m.speaking, m.count, m.quiet, m.held


def summaries(rows: DataFrame, rules: Rules, session: str, kind: str) -> DataFrame:
    """SUMMARY for each (session, chunk) of rows (session, chunk, first, idx, p, entry); rows before ``first`` only lead up to the chunk."""
    dealt = rows.repartition(session, "chunk").sortWithinPartitions(session, "chunk", "idx")
    columns = [session, *[c.split()[0] for c in ("chunk", "entry", "left", "carried_end", "opened", "last", "found")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m, entry, carried, carried_end, found, opened = None, None, None, False, None, [], None

        def summary() -> tuple:
            return (*now, entry, state_of(m), carried_end, opened if m.speaking and not carried else None, m.index, found)

        for batch in batches:
            out = []
            for s, chunk, first, idx, p, given in zip(*(batch[c].tolist() for c in (session, "chunk", "first", "idx", "p", "entry")), strict=True):
                if now != (s, chunk):
                    if now is not None:
                        out.append(summary())
                    now, m, entry, carried, carried_end, found, opened = (s, chunk), Machine(rules), None, False, None, [], None
                    m.index = idx - 1
                if idx == first:
                    if given is not None:
                        m.average, m.speaking, m.count, m.quiet, m.held = (given[k] for k in ("average", "speaking", "count", "quiet", "held"))
                    entry, carried = state_of(m), m.speaking
                closed = m.step(p)
                if entry is None:
                    continue
                if m.speaking and not carried:
                    opened = m.start
                if closed and carried:
                    carried, carried_end = False, closed[1]
                elif closed:
                    found.append(closed)
            yield pd.DataFrame(out, columns=columns)
        if now is not None:
            yield pd.DataFrame([summary()], columns=columns)

    return dealt.mapInPandas(run, f"{session} {kind}, {SUMMARY}")


def segments(frames: DataFrame, rules: Rules, *, session: str = "session_id", index: str = "frame_idx", prob: Column | None = None, chunk: int = 8192, warm: int = 256) -> DataFrame:
    """(session, seg_seq, start_frame, end_frame, is_flush), as vad.segments() gives them.

    ``index`` numbers a session's frames from 0 without gaps or repeats. A null probability is 0.
    """
    value = F.coalesce(prob if prob is not None else F.col("prob"), F.lit(0.0)).cast("double")
    kind = frames.schema[session].dataType.simpleString()
    own = F.floor(F.col(index) / chunk)
    base = frames.select(F.col(session), F.col(index).cast("long").alias("idx"), value.alias("p"))
    # the last frames of a chunk also lead up to the next one
    places = F.array_compact(F.array(own, F.when(F.col(index) % chunk >= chunk - warm, own + 1)))
    spread = frames.select(session, F.col(index).cast("long").alias("idx"), value.alias("p"), F.explode(places).alias("chunk"))
    spread = spread.withColumns({"first": F.col("chunk") * chunk, "entry": F.lit(None).cast(STATE)})
    # a lead-up with no chunk after it has no summary: its entry is never reached
    now = stored(summaries(spread, rules, session, kind).where(F.col("entry").isNotNull()), "chunks")
    while True:
        before = now.select(session, (F.col("chunk") + 1).alias("chunk"), F.col("left").alias("right_entry"))
        wrong = now.join(before, [session, "chunk"]).where(~F.col("entry").eqNullSafe(F.col("right_entry"))).select(session, "chunk", F.col("right_entry").alias("entry"))
        wrong = stored(wrong, "seams")
        if wrong.isEmpty():
            drop(wrong)
            break
        again = base.withColumn("chunk", F.floor(F.col("idx") / chunk)).join(wrong, [session, "chunk"]).withColumn("first", F.col("chunk") * chunk)
        then = stored(now.join(wrong, [session, "chunk"], "left_anti").unionByName(summaries(again, rules, session, kind)), "chunks")
        drop(wrong)
        drop(now)
        now = then
    order = Window.partitionBy(session).orderBy("chunk")
    opened = F.last("opened", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = now.withColumns({"open_before": opened, "is_last": F.lead("chunk").over(order).isNull()})
    carried = known.where("carried_end IS NOT NULL").select(session, F.col("open_before").alias("start_frame"), F.col("carried_end").alias("end_frame"), F.lit(False).alias("is_flush"))
    inside = known.select(session, F.explode("found").alias("f")).select(session, "f.start", "f.stop", F.lit(False))
    flushed = known.where(F.col("is_last") & F.col("left.speaking")).select(session, F.coalesce("opened", "open_before"), "last", F.lit(True))
    every = carried.union(inside).union(flushed)
    return every.withColumn("seg_seq", F.row_number().over(Window.partitionBy(session).orderBy("start_frame")).cast("long") - 1).select(session, "seg_seq", "start_frame", "end_frame", "is_flush")

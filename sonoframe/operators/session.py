"""Session control: state as of an event, terminators, latest partials, bounded histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.operators.messages import terminator


def as_of(events: DataFrame, controls: DataFrame, session: str, order: str, columns: list[str]) -> DataFrame:
    """Each event with the last value, up to it, of the controls' columns; at the same place a control counts as earlier.

    One shuffle by session: both are united and the values carried forward, no pair of rows is formed.
    """
    wanted = {c: controls.schema[c].dataType for c in columns}
    left = events.select("*", F.lit(1).alias("_side"), *[F.lit(None).cast(t).alias(f"_{c}") for c, t in wanted.items()])
    right = controls.select(session, order, F.lit(0).alias("_side"), *[F.col(c).alias(f"_{c}") for c in columns])
    # controls at one place come in order of their values, so the last of them is the same in every run
    w = Window.partitionBy(session).orderBy(order, "_side", *[f"_{c}" for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    carried = both.withColumns({f"{c}_as_of": F.last(f"_{c}", ignorenulls=True).over(w) for c in columns})
    return carried.where("_side = 1").drop("_side", *[f"_{c}" for c in columns])


def started(messages: DataFrame, session: str, order: str, kind: Column) -> DataFrame:
    """Rows from each session's first start on, up to its first stop; later starts are left out. Rows at one place come in order of their kind."""
    w = Window.partitionBy(session).orderBy(order, kind)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    start, stop = F.when(kind == "start", 1).otherwise(0), F.when(kind == "stop", 1).otherwise(0)
    df = messages.withColumns({"_on": F.max(start).over(upto), "_again": F.coalesce(F.sum(start).over(before), F.lit(0)), "_off": F.coalesce(F.max(stop).over(before), F.lit(0))})
    return df.where((F.col("_on") == 1) & (F.col("_off") == 0) & ~((kind == "start") & (F.col("_again") > 0))).drop("_on", "_again", "_off")


def with_enrollment(segments: DataFrame, enrollments: DataFrame, session: str) -> DataFrame:
    """Segments of enrolled sessions with their enrollment; segments without one go."""
    return segments.join(enrollments, session, "inner")


def terminators(sessions: DataFrame, outputs: DataFrame, session: str) -> DataFrame:
    """(session, message): the empty message of each stopped session that put out nothing, where its task has one.

    ``sessions`` has ``stopped``, ``task``, ``language``, ``mode`` and ``streaming``.
    """
    silent = sessions.where("stopped").join(outputs.select(session).distinct(), session, "left_anti")
    message = terminator(F.col("task"), F.col("language"), F.col("mode"), F.col("streaming"))
    return silent.select(session, message.alias("message")).where(F.col("message").isNotNull())


def answered(requests: DataFrame, answers: DataFrame, session: str, order: str, request: str = "request_id") -> DataFrame:
    """Answers to the request that their session waits for: its newest one so far, if that isn't answered yet.

    At the same place a request counts as earlier. One shuffle by session.
    """
    waiting = as_of(answers, requests.withColumnRenamed(request, "_asked"), session, order, ["_asked"])
    fits = waiting.where(F.col(request) == F.col("_asked_as_of"))
    first = Window.partitionBy(session, request).orderBy(order)
    return fits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_asked_as_of")


def utterances(frames: DataFrame, session: str, order: list[str], speaking: str = "speaking") -> DataFrame:
    """``frames`` with ``utterance``: an ordinal from 1, new when speech begins and null when there is none."""
    w = Window.partitionBy(session).orderBy(*order)
    begins = F.when(F.col(speaking) & ~F.coalesce(F.lag(speaking).over(w), F.lit(False)), 1).otherwise(0)
    number = F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("_begins", begins).withColumn("utterance", F.when(F.col(speaking), number)).drop("_begins")


def single_flight(snapshots: DataFrame, session: str, at: str, took: str, interval: float = 0.0) -> DataFrame:
    """Snapshots (session, at) that are sent: none while the one before is in flight, nor within ``interval`` of its start; of several at one time the quickest counts.

    What a session sends depends on what it sent before: a task runs along its sessions' snapshots in order, with one
    number in hand.
    """
    kind = snapshots.schema[session].dataType.simpleString()
    dealt = snapshots.select(F.col(session).alias("_s"), F.col(at).cast("double").alias("_at"), F.col(took).cast("double").alias("_took")).repartition(F.col("_s")).sortWithinPartitions("_s", "_at", "_took")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, first = None, None, True
        for batch in batches:
            sent = []
            for s, t, n in zip(batch["_s"].tolist(), batch["_at"].tolist(), batch["_took"].tolist(), strict=True):
                if first or s != now:
                    now, free, first = s, None, False
                if free is None or t >= free:
                    free = max(t + n, t + interval)
                    sent.append((s, t))
            yield pd.DataFrame(sent, columns=[session, at])

    return dealt.mapInPandas(run, f"{session} {kind}, {at} double")


def latest_wins(partials: DataFrame, session: str, arrival: str, seq: str) -> DataFrame:
    """Partials whose number is over all that came before."""
    before = Window.partitionBy(session).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return partials.withColumn("_m", F.max(seq).over(before)).where(F.col("_m").isNull() | (F.col(seq) > F.col("_m"))).drop("_m")


def newest(rows: DataFrame, session: str, order: list[str], most: int = 8) -> DataFrame:
    """Each session's last ``most`` rows, numbered from the newest."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def bounded_queue(events: DataFrame, session: str, order: list[str], size: int) -> DataFrame:
    """The first ``size`` events of a session that is never drained: newer ones are dropped."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("_n") <= size).drop("_n")


def running_hits(finals: DataFrame, session: str, order: list[str], hits: str) -> DataFrame:
    return finals.withColumn("total_hits", F.sum(hits).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def numbered_outputs(finals: DataFrame, session: str, order: list[str], text: str = "text") -> DataFrame:
    """Messages with text, with ``ordinal`` from 1 in each session."""
    return finals.where(F.coalesce(text, F.lit("")) != "").withColumn("ordinal", F.row_number().over(Window.partitionBy(session).orderBy(*order)))

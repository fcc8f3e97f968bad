"""Two models' hypotheses as two streams, paired by segment while both come in, and what a session still gets after it closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonoframe.functions import hotwords as hw
from sonoframe.functions.text import strip, text_or_empty
from sonoframe.operators import fusion
from sonoframe.params import Params


def pair_streams(primary: DataFrame, secondary: DataFrame, *, key: str = "segment_id", at: str = "at", within: str = "10 seconds", late: str = "5 seconds") -> DataFrame:
    """Streams (key, at, text[, reported][, failed]) side by side, as fusion.pair_hypotheses() gives batches.

    A full outer join of streams: two hypotheses pair if their times are at most ``within`` apart; one whose partner
    doesn't come is put out alone once the watermark, ``late`` behind the newest row, is past that bound, and then
    its state goes. A hypothesis that ``failed`` is as if it hadn't come. ``at`` is the earlier of both times. Each
    stream has one row a segment.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        good = df.where(~F.coalesce("failed", F.lit(False))) if "failed" in df.columns else df
        reported = F.col("reported") if "reported" in df.columns else hw.empty()
        return good.select(F.col(key).alias(f"{name}_key"), F.col(at).alias(f"{name}_at"), F.col("text").alias(f"{name}_text"), reported.alias(f"{name}_reported"), F.lit(True).alias(f"{name}_there")).withWatermark(f"{name}_at", late)

    span = F.expr(f"INTERVAL {within}")
    near = (F.col("secondary_at") >= F.col("primary_at") - span) & (F.col("secondary_at") <= F.col("primary_at") + span)
    both = side(primary, "primary").join(side(secondary, "secondary"), (F.col("primary_key") == F.col("secondary_key")) & near, "full_outer")
    there = {f"{n}_there": F.coalesce(f"{n}_there", F.lit(False)) for n in ("primary", "secondary")}
    return both.withColumns(there).select(
        F.coalesce("primary_key", "secondary_key").alias(key), F.least("primary_at", "secondary_at").alias(at),
        "primary_text", "primary_reported", "primary_there", "secondary_text", "secondary_reported", "secondary_there",
    )


def fused_stream(primary: DataFrame, secondary: DataFrame, params: Params = Params(), *, hotwords: Column | None = None, similarity: Column | None = None, key: str = "segment_id", **how) -> DataFrame:
    """(key, at, final) of the segments that two streams of hypotheses say anything of. A secondary hypothesis without text silences its segment, whatever the primary one says."""
    said = fusion.final_text(pair_streams(primary, secondary, key=key, **how), params, hotwords=hotwords, similarity=similarity)
    silenced = F.col("secondary_there") & (strip(text_or_empty("secondary_text")) == "")
    return said.where((F.col("final") != "") & ~silenced).select(key, "at", "final")


class UntilClosed(StatefulProcessor):
    """Hands a session's messages on in order of arrival until its closing one, and none after it."""

    def __init__(self, columns: list[str], order: str, closing: str):
        self.columns, self.order, self.closing = columns, order, closing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        if self.closed.exists():
            return
        ends = every[self.closing].fillna(False).to_numpy(bool)
        if ends.any():
            every = every.iloc[: int(ends.argmax()) + 1]
            self.closed.update((True,))
        yield every[self.columns]

    def close(self) -> None:
        pass


def until_closed(messages: DataFrame, *, session: str = "session_id", order: str = "seq", closing: str = "closing") -> DataFrame:
    """A stream's messages but for those of sessions that were closed before, by a row whose ``closing`` is true. A closed session's mark stays, so ids aren't used again. Needs the RocksDB state store."""
    return messages.groupBy(session).transformWithStateInPandas(UntilClosed(messages.columns, order, closing), messages.schema, "append", "None")

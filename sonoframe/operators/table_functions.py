"""Audio streams as table functions: SQL hands a session's chunks over in order, and gets its pieces as rows.

    SELECT * FROM speech_segments(TABLE(chunks) PARTITION BY session_id ORDER BY seq)

A table has ``session_id``, ``payload`` and whatever orders it. Each session is a partition of its own, in one task
with the others that Spark deals there; what is held is the stream's open piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from sonoframe.operators.streams import SEGMENT, AudioStream, SegmentStream, UtteranceStream
from sonoframe.operators.vad import Rules
from sonoframe.params import Params


def table_function(make: Callable[[], AudioStream], session_type: str = "string"):
    """A table function of an audio stream: rows are fed, the end of a partition flushes."""

    @F.udtf(returnType=f"session_id {session_type}, {SEGMENT}")
    class Stream:
        def __init__(self):
            self.stream, self.session = make(), None

        def eval(self, row: Row) -> Iterator[tuple]:
            self.session = row["session_id"]
            for heard in self.stream.feed(bytes(row["payload"] or b"")):
                yield (self.session, *heard)

        def terminate(self) -> Iterator[tuple]:
            for heard in self.stream.flush():
                yield (self.session, *heard)

    return Stream


def register(spark: SparkSession, rules: Rules, params: Params = Params(), *, session_type: str = "string") -> None:
    """``speech_segments`` and ``whole_utterances`` for SQL."""
    spark.udtf.register("speech_segments", table_function(lambda: SegmentStream(rules, params), session_type))
    spark.udtf.register("whole_utterances", table_function(lambda: UtteranceStream(params, params.emotion_max_sec), session_type))

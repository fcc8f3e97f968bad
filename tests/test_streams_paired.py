"""Streams of two hypotheses, restarts, and delivery that a rerun doesn't repeat."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sonoframe.functions import audio as au
from sonoframe.functions import hotwords as hw
from sonoframe.operators import engine, fusion, long_sessions, mentions, vad
from sonoframe.params import Params
from sonoframe.sources import sinks
from sonoframe.streaming import pairing

START = datetime(2024, 1, 1, tzinfo=UTC)
HYPOTHESES = "segment_id string, at timestamp, text string, failed boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def streaming(spark):
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


def said(segment, second, text, failed=False):
    return (segment, START + timedelta(seconds=second), text, failed)


def arrive(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_hypotheses_pair_while_they_come(streaming, tmp_path):
    primary = [[said("a", 0, "hello there"), said("late", 1, "one side"), said("both", 1, "x", True)], [said("c", 3, "call me")], [said("end", 100, "z")], [said("end2", 200, "z")], [said("end3", 300, "z")]]
    secondary = [[said("b", 0, "only second"), said("both", 1, "y", True)], [said("a", 2, "hello there"), said("c", 4, "")], [said("end", 100, "z")], [said("late", 101, "too late"), said("end2", 200, "z")], [said("end3", 300, "z")]]
    one = arrive(streaming, tmp_path / "p", primary, HYPOTHESES)
    two = arrive(streaming, tmp_path / "s", secondary, HYPOTHESES)
    pairs = pairing.pair_streams(one, two, within="10 seconds", late="1 second")
    q = pairs.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = {r["segment_id"] + ("2" if r["segment_id"] == "late" and r["secondary_there"] else ""): r for r in streaming.table("pairs").collect()}
    sides = {k: (r["primary_there"], r["secondary_there"]) for k, r in got.items()}
    # both failed: nothing; a partner that is out of time comes alone, and so does the one that it missed
    assert {k: v for k, v in sides.items() if not k.startswith("end")} == {"a": (True, True), "b": (False, True), "c": (True, True), "late": (True, False), "late2": (False, True)}
    # the batch that holds the same rows gives the same pairs, but for those that were out of time
    rows = lambda parts: streaming.createDataFrame([r for p in parts for r in p if not r[3] and r[0] != "late"], HYPOTHESES)
    twin = fusion.pair_hypotheses(rows(primary), rows(secondary))
    want = {(r["segment_id"], r["primary_text"], r["secondary_text"]) for r in twin.collect()}
    assert {(r["segment_id"], r["primary_text"], r["secondary_text"]) for k, r in got.items() if not k.startswith("late")} == want
    # state is bounded: what the watermark passed is gone
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 4


def test_fused_stream_is_silent_where_the_second_model_is(streaming, tmp_path):
    one = arrive(streaming, tmp_path / "p", [[said("a", 0, "hello there world"), said("c", 0, "noise")], [said("z", 90, "")], [said("z2", 190, "")]], HYPOTHESES)
    two = arrive(streaming, tmp_path / "s", [[said("a", 0, "hello there world"), said("c", 0, " ")], [said("z", 90, "")], [said("z2", 190, "")]], HYPOTHESES)
    q = pairing.fused_stream(one, two, late="1 second").writeStream.format("memory").queryName("fused").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert [(r["segment_id"], r["final"]) for r in streaming.table("fused").collect()] == [("a", "hello there world")]


def test_a_failed_batch_is_delivered_once(streaming, tmp_path):
    schema = "session_id string, seq long, message string"
    stream = arrive(streaming, tmp_path / "in", [[("s", i, f"m{i}")] for i in range(4)], schema)
    sent, failed = [], []

    def send(rows, batch):
        if batch == 2 and not failed:
            failed.append(batch)
            raise OSError("socket closed")
        sent.extend(r["message"] for r in rows.collect())

    def start():
        return sinks.deliver_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), send=send).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="socket closed"):
        start().awaitTermination(200)
    start().awaitTermination(200)
    assert sent == ["m0", "m1", "m2", "m3"]
    stored = sinks.delivered(streaming, str(tmp_path / "out")).collect()
    assert sorted((r["batch"], r["message"]) for r in stored) == [(i, f"m{i}") for i in range(4)]
    # a batch that is run again changes nothing, and isn't handed on
    start().awaitTermination(200)
    assert len(sent) == 4 and sinks.delivered(streaming, str(tmp_path / "out")).count() == 4


def test_nothing_follows_a_closed_session(streaming, tmp_path):
    schema = "session_id string, seq long, message string, closing boolean"
    batches = [[("s", 1, "b", False), ("s", 0, "a", False), ("t", 0, "x", None)], [("s", 3, "late", False), ("s", 2, "end", True)], [("s", 4, "later", False), ("t", 1, "y", False)]]
    stream = pairing.until_closed(arrive(streaming, tmp_path / "in", batches, schema))
    q = stream.writeStream.format("memory").queryName("closing").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = sorted((r["session_id"], r["seq"], r["message"]) for r in streaming.table("closing").collect())
    assert got == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "end"), ("t", 0, "x"), ("t", 1, "y")]


def test_long_sessions_equal_one_run_for_any_cut(spark):
    import random

    rng = random.Random(7)
    rules = vad.Rules(0.5, 0.9, 3, 4, 1, 6)
    rows = []
    for s in range(3):
        p = 0.0
        for i in range(700):
            p = min(1.0, max(0.0, p + rng.uniform(-0.4, 0.4))) if s < 2 else 1.0 * (i > 20)
            rows.append((s, i, p))
    df = spark.createDataFrame(rows, "session_id int, frame_idx long, prob double")
    want = sorted(map(tuple, vad.segments(df, rules).collect()))
    for chunk, warm in ((700, 10), (64, 3), (50, 50)):
        assert sorted(map(tuple, long_sessions.segments(df, rules, chunk=chunk, warm=warm).collect())) == want
    assert long_sessions.segments(df.limit(0), rules).collect() == []


def test_both_ways_find_the_same_words(spark):
    texts = spark.createDataFrame([(1, "abcabcdefg é😀xyz"), (2, None), (3, ""), (4, "ab"), (None, "abc"), (1, "second row"), (5, "x" * 70_000 + "needle" + "y" * 70_000)], "doc_id long, text string")
    words = spark.createDataFrame([("abc",), ("abcdefg",), ("a",), ("",), (None,), ("é😀x",), ("row",), ("needle",), ("xneedley",), ("zzz",), ("abc",)], "word string")
    want = {(1, w) for w in ("abc", "abcdefg", "a", "é😀x", "row")} | {(4, "a"), (5, "needle"), (5, "xneedley")}
    for most in (10**6, 0):
        got = mentions.mentions(texts, words, most_letters=most)
        rows = got.collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert mentions.mentions(texts, words.limit(0)).collect() == [] == mentions.mentions(texts, words.limit(0), most_letters=-1).collect()


def test_highlights_are_places_of_the_text_itself(spark):
    cases = [("İİ ontion x", [" ontion "]), ("a<b & B", ["b"]), ("abcab", ["abc", "ab", "cab"]), ("", ["x"]), (None, None), ("Ab aB", ["ab", "", None])]
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(cases)], "i int, text string, words array<string>")
    got = [tuple(r) for r in df.withColumn("s", hw.highlight_spans("text", "words")).select("i", "s", hw.highlighted(F.col("text"), F.col("s")).alias("html")).orderBy("i").collect()]
    mark = lambda x: f'<mark class="hotword-hit">{x}</mark>'
    assert [[tuple(s) for s in r[1]] for r in got] == [[(3, 9)], [(2, 3), (6, 7)], [(0, 3), (3, 5)], [], [], [(0, 2), (3, 5)]]
    assert [r[2] for r in got] == [f"İİ {mark('ontion')} x", f"a&lt;{mark('b')} &amp; {mark('B')}", mark("abc") + mark("ab"), "", "", f"{mark('Ab')}&nbsp;{mark('aB')}"]


def test_quiet_segments_never_reach_the_target_model(spark):
    loud, quiet = au.to_pcm16(au.tone(1.0) * 8), bytes(32_000)
    segments = spark.createDataFrame([("t", 1, "loud", bytearray(loud), ""), ("t", 2, "quiet", bytearray(quiet), ""), ("u", 1, "other", bytearray(loud), "")], "session_id string, place long, segment_id string, pcm binary, language string")
    enrolled = spark.createDataFrame([("t", bytearray(2), None, "an old voice"), ("u", None, "too_short", None)], "session_id string, pcm binary, error string, voice_traits string")
    model = lambda clips: clips.select("segment_id", F.concat_ws(" ", "segment_id", "voice_traits").alias("text"), F.lit("").alias("detected_language"))
    sessions = spark.createDataFrame([("t", True, "Thai"), ("u", True, "Thai")], "session_id string, stopped boolean, language string")
    task = engine.TargetTranscription(model, enrolled, Params())
    got = sorted((r["session_id"], r["message"]) for r in engine.run(task, segments, sessions=sessions).collect())
    assert [s for s, _ in got] == ["t", "u", "u"] and '"text":"loud an old voice"' in got[0][1]
    assert {m for s, m in got if s == "u"} == {'{"type":"error","code":"enrollment_too_short"}', '{"type":"final","text":"","language":"Thai","task":"tsasr"}'}

"""Live sessions over several micro-batches: sound, order, gaps, ends, partials, and what timeouts do."""

from __future__ import annotations

import base64
import json
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from sonoframe.functions import audio as au
from sonoframe.operators import streams, vad
from sonoframe.params import Params
from sonoframe.sources import live
from sonoframe.streaming import live_session, tasks

RULES = vad.Rules(0.65, 0.0, 2, 3, 1, 2)
PARAMS = Params().override({"hop": 10, "min_segment_ms": 0})
SCHEMA = "session_id string, seq long, at timestamp, kind string, payload binary, body string"
START = datetime(2024, 1, 1, tzinfo=UTC)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def streaming(spark):
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


def row(session, seq, kind="frame", payload=None, body=None, ms=None):
    return (session, seq, START + timedelta(milliseconds=10 * seq if ms is None else ms), kind, payload, body)


def run(spark, tmp_path, batches, name, late="0 seconds", **how):
    folder = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    found = live_session.live_sessions(stream, RULES, PARAMS, late=late, **how)
    q = found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name).collect()


def sound(pattern, seed=0):
    """Frames of 10 samples, loud for 1 and silent for 0."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.uniform(0.2, 0.5, 10) * (p == "1") for p in pattern])
    return au.to_pcm16(x.astype(np.float32))


def cut(data, rng):
    out = []
    while data:
        n = rng.randrange(1, 60)
        out.append(data[:n])
        data = data[n:]
    return out


def pieces(session, data, rng):
    chunks = cut(data, rng)
    return [row(session, i, payload=c) for i, c in enumerate(chunks)] + [row(session, len(chunks), "stop")]


def test_shuffled_rows_of_many_batches_give_the_batch_twin(streaming, tmp_path):
    rng = random.Random(2)
    rows = []
    for s in range(4):
        rows += pieces(f"s{s}", sound("".join(rng.choice(["0000", "111", "11111", "01"]) for _ in range(12)), s), rng)
    mixed = rows[:]
    rng.shuffle(mixed)
    mixed += rng.sample(mixed, 10)  # repeated rows count once
    parts = [mixed[i::5] for i in range(5)]
    got = run(streaming, tmp_path, parts, "twin", late="1 hour", gap_ms=10**9, timeout_ms=10**9)
    twin = streams.heard(streaming.createDataFrame(rows, SCHEMA).where("kind = 'frame'"), lambda: streams.SegmentStream(RULES, PARAMS)).collect()
    key = lambda r: (r["session_id"], r["seg_seq"], r["start_frame"], r["end_frame"], r["is_flush"], bytes(r["pcm"]))
    assert sorted(map(key, got)) == sorted(map(key, twin)) and len(twin) > 4 and {r["kind"] for r in got} == {"final"}
    assert all(len(r["pcm"]) == 20 * (r["end_frame"] - r["start_frame"] + 1) for r in got)


def test_a_lost_row_is_given_up_by_a_timer(streaming, tmp_path):
    loud, quiet = sound("11"), sound("000")
    batches = [[row("s", 0, payload=loud, ms=0)], [row("s", 2, payload=quiet, ms=20)], [row("t", 0, payload=quiet, ms=400)], [row("t", 1, payload=quiet, ms=900)], [row("s", 3, "stop", ms=910)]]
    got = run(streaming, tmp_path, batches, "lost", gap_ms=300, timeout_ms=10**9)
    assert [(r["session_id"], r["start_frame"], r["end_frame"], r["is_flush"]) for r in got] == [("s", 0, 2, False)]


def test_ends_after_a_stop_only(streaming, tmp_path):
    quiet, loud = sound("0000"), sound("0111000")
    body = json.dumps({"language": "Thai"})
    batches = [
        [row("silent", 0, "start", body=body, ms=0), row("silent", 1, payload=quiet, ms=1), row("spoken", 0, payload=loud, ms=0), row("gone", 0, payload=loud[:80], ms=0), row("mute", 0, payload=quiet, ms=0)],
        [row("silent", 2, "stop", ms=10), row("spoken", 1, "stop", ms=10)],
        [row("late", 0, payload=quiet, ms=5000)],
        [row("late", 1, payload=quiet, ms=9000)],
        [row("gone", 0, payload=loud, ms=9500), row("gone", 1, "stop", ms=9501)],
    ]
    got = sorted(run(streaming, tmp_path, batches, "ends", timeout_ms=1000), key=lambda r: (r["session_id"], r["epoch"]))
    assert [(r["session_id"], r["kind"], r["seg_seq"], r["is_flush"], r["language"]) for r in got if r["session_id"] != "gone"] == [("silent", "end", None, None, "Thai"), ("spoken", "final", 0, False, None)]
    # a disconnected session's open segment is closed; when it speaks again its epoch is another
    gone = [r for r in got if r["session_id"] == "gone"]
    assert [(r["kind"], r["seg_seq"], r["is_flush"]) for r in gone][:1] == [("final", 0, True)] and len({(r["epoch"], r["seg_seq"]) for r in gone}) == len(gone) == 2


def test_answers_decide_what_is_put_out(streaming, tmp_path):
    def respond(pcm, controls, final):
        return f"{controls.get('hotwords')} {len(pcm)}" if final and controls.get("hotwords") else "  "

    loud = sound("0111000")
    batches = [[row("a", 0, payload=loud), row("b", 0, "start", body=json.dumps({"hotwords": ["x"]}))], [row("b", 1, payload=loud), row("a", 1, "stop"), row("b", 2, "stop")]]
    got = sorted(run(streaming, tmp_path, batches, "answers", respond=respond), key=lambda r: r["session_id"])
    assert [(r["session_id"], r["kind"], r["text"]) for r in got] == [("a", "end", ""), ("b", "final", "['x'] 80")]
    assert not run(streaming, tmp_path / "two", [batches[0][:1], batches[1][1:2]], "segmented", respond=respond, ends=False)


def test_partials_keep_their_distance_in_time(streaming, tmp_path):
    frames = [row("s", i, payload=sound("1", i), ms=10 * i) for i in range(30)]
    got = run(streaming, tmp_path, [frames[:15], frames[15:]], "timed", partial_ms=100)
    partials = [r for r in got if r["kind"] == "partial"]
    assert [(r["start_frame"], r["end_frame"]) for r in partials] == [(0, 1), (0, 11), (0, 21)]
    assert [len(r["pcm"]) for r in partials] == [40, 240, 440]
    assert bytes(partials[2]["pcm"]) == b"".join(f[4] for f in frames[:22])


def test_captures_of_a_killed_stream_are_read_once(streaming, tmp_path):
    rng = random.Random(4)
    folder, out = tmp_path / "captures", tmp_path / "out"
    folder.mkdir()
    loud, quiet = sound("0111000"), sound("00")
    chunks = cut(loud, rng)

    def line(session, seq, text=None, data=None):
        return json.dumps({"session_id": session, "seq": seq, "at": f"2024-01-01T00:00:{seq:02d}Z", **({"text": json.dumps(text)} if text else {"audio_b64": base64.b64encode(data).decode()})}) + "\n"

    lines = [line("a", 0, {"type": "start", "hotwords": ["x"], "language": "Thai"}), *[line("a", 1 + i, data=c) for i, c in enumerate(chunks)]]
    lines += [line("b", 0, {"type": "start"}), line("b", 1, {"type": "ping"}), line("b", 2, data=quiet), line("b", 3, {"type": "stop"})]
    lines += [line("a", len(chunks) + 1, {"type": "update_hotwords", "hotwords": ["y"], "src_lang": "English"}), line("a", len(chunks) + 2, {"type": "stop"})]
    rng.shuffle(lines)
    half = len(lines) // 2
    calls = []

    def go(name):
        rows, rate = live.task_stream(streaming, str(folder), "asr", files_per_batch=1)
        found = tasks.live_messages(rows, "asr", lambda pcm, controls, final: f"{len(pcm)} {controls['hotwords']}", PARAMS, rules=RULES, partials=False, need_start=True, late="1 hour", rate=rate)
        q = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        calls.append(name)

    (folder / "1.json").write_text("".join(lines[:half]))
    go("first")
    (folder / "2.json").write_text("".join(lines[half:]))
    go("second")
    go("third")
    got = sorted((r["session_id"], r["kind"], r["message"]) for r in streaming.read.parquet(str(out)).collect())
    assert got == [("a", "final", '{"type":"final","text":"80 [\'x\']","language":"Thai"}'), ("b", "end", '{"type":"final","text":"","language":""}')]


def test_bytes_at_48_khz_give_the_segments_of_16(streaming, tmp_path):
    rng = random.Random(6)
    wide = np.repeat(au.pcm16(sound("0001111110000011111000")), 3)
    data = au.to_pcm16(wide)
    whole = au.to_pcm16(au.Decimator().feed(au.pcm16(data)))
    chunks = cut(data, rng)
    rows = [row("s", i, payload=c) for i, c in enumerate(chunks)] + [row("s", len(chunks), "stop")]
    rng.shuffle(rows)
    got = run(streaming, tmp_path, [rows[i::3] for i in range(3)], "wide", late="1 hour", gap_ms=10**9, timeout_ms=10**9, rate=48_000)
    assert len(got) == 2
    for r in got:
        assert bytes(r["pcm"]) == whole[20 * r["start_frame"] : 20 * (r["end_frame"] + 1)]


def test_messages_of_the_other_tasks(streaming, tmp_path):
    loud = sound("0111000")
    batch = [row("s", 0, "start", body=json.dumps({"language": "Thai"})), row("s", 1, payload=loud), row("s", 2, "stop"), row("q", 0, payload=sound("000")), row("q", 1, "stop")]
    for task, want in (("emotion", {"s"}), ("tsasr", {"s", "q"})):
        folder = tmp_path / task / "in"
        streaming.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(folder))
        stream = streaming.readStream.schema(SCHEMA).parquet(str(folder))
        found = tasks.live_messages(stream, task, lambda pcm, controls, final: "Sad", PARAMS, rules=RULES, late="1 hour")
        q = found.writeStream.format("memory").queryName(f"messages_{task}").option("checkpointLocation", str(tmp_path / task / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
        got = {r["session_id"]: json.loads(r["message"]) for r in streaming.table(f"messages_{task}").where("kind <> 'partial'").collect()}
        assert set(got) == want and got["s"]["text"] == "Sad" and got["s"]["language"] == "Thai"
        assert task == "emotion" or (got["q"]["task"] == "tsasr" and got["q"]["text"] == "")

"""Samples of sound: WAV files, raw PCM, resampling and energy, for tasks that hold one clip at a time."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.columns import binaries, doubles, lists, strings

RATE = 16_000
#: Taps and shape of the low-pass before every third sample is taken. The default cutoff is that of the service whose
#: numbers these must equal; 1/6 is the cutoff that keeps what lies over 8 kHz from folding down.
TAPS, BETA, CUTOFF = 65, 6.0, 1 / 3
#: Energy that counts as silence, and as certain speech.
FLOOR, CEILING = 0.008, 0.06
DECODED = T.StructType([T.StructField("pcm", T.BinaryType()), T.StructField("seconds", T.DoubleType()), T.StructField("error", T.StringType())])


class AudioError(ValueError):
    """A clip that can't be read."""


def pcm16(data: bytes) -> np.ndarray:
    """Raw little-endian 16-bit samples as floats; an odd last byte is left out."""
    return np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2").astype(np.float32) / 32768


def to_pcm16(x: np.ndarray) -> bytes:
    return np.clip(x * 32767, -32768, 32767).astype("<i2").tobytes()


def wav(x: np.ndarray, rate: int = RATE) -> bytes:
    """A mono 16-bit WAV file."""
    body = to_pcm16(np.asarray(x, dtype=np.float32))
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(body), b"WAVE") + form + struct.pack("<4sI", b"data", len(body)) + body


def chunks(data: bytes) -> dict[bytes, bytes]:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise AudioError("not a WAV file")
    found, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        found.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def integers(body: bytes, width: int) -> np.ndarray:
    """Integer samples of 1 to 4 bytes, scaled to -1..1; one byte is unsigned."""
    body = body[: len(body) // width * width]
    if width == 1:
        return (np.frombuffer(body, dtype=np.uint8).astype(np.float32) - 128) / 128
    if width == 2:
        return pcm16(body)
    if width == 3:
        # a zero byte below makes each sample a 32-bit one
        wide = np.zeros((len(body) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        return (wide.view("<i4")[:, 0] >> 8).astype(np.float32) / (1 << 23)
    return np.frombuffer(body, dtype="<i4").astype(np.float32) / (1 << 31)


def downmix(x: np.ndarray, channels: int) -> np.ndarray:
    return x if channels == 1 else x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)


def read_wav(data: bytes) -> np.ndarray:
    """Mono samples at 16 kHz of an integer PCM file of any rate and channels; AudioError for anything else."""
    if not data:
        raise AudioError("empty payload")
    found = chunks(data)
    form = found.get(b"fmt ", b"")
    if len(form) < 16:
        raise AudioError("no format chunk")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not rate:
        raise AudioError("not integer PCM")
    x = downmix(integers(found.get(b"data", b""), bits // 8), channels).astype(np.float32)
    if rate == RATE or not len(x):
        return x
    return Decimator().feed(x) if rate == 3 * RATE else resample(x, rate)


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """By straight lines between samples, from the first to the last."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.float32)


def low_pass(cutoff: float = CUTOFF) -> np.ndarray:
    t = np.arange(TAPS) - TAPS // 2
    h = np.sinc(2 * cutoff * t) * np.kaiser(TAPS, BETA)
    return (h / h.sum()).astype(np.float32)


class Decimator:
    """48 to 16 kHz over chunks: its history makes chunked output equal that of the whole."""

    def __init__(self, cutoff: float = CUTOFF, state: tuple[bytes, bytes] | None = None):
        self.taps = low_pass(cutoff)
        self.history = np.frombuffer(state[0], np.float32) if state else np.zeros(TAPS - 1, np.float32)
        self.rest = np.frombuffer(state[1], np.float32) if state else np.zeros(0, np.float32)

    def feed(self, x: np.ndarray) -> np.ndarray:
        x = np.concatenate((self.rest, x)).astype(np.float32)
        whole = len(x) // 3 * 3
        self.rest = x[whole:]
        if not whole:
            return np.zeros(0, np.float32)
        line = np.concatenate((self.history, x[:whole]))
        self.history = line[-(TAPS - 1) :]
        return np.convolve(line, self.taps, "valid")[::3].astype(np.float32)

    @property
    def state(self) -> tuple[bytes, bytes]:
        return self.history.astype(np.float32).tobytes(), self.rest.astype(np.float32).tobytes()


def decimated(samples: DataFrame, *, session: str = "session_id", index: str = "i", value: str = "x", cutoff: float = CUTOFF, block: int = 4096) -> DataFrame:
    """(session, m, y): every third sample of a low-passed session, as Decimator gives it for the whole session.

    ``samples`` has a row for each sample, numbered from 0 without gaps. They are dealt by blocks of outputs, each
    with the samples before it that its first outputs need, so neither the length of a session nor where its chunks
    end matters; an output is a dot product of its samples and the taps.
    """
    taps = F.array(*[F.lit(float(t)) for t in low_pass(cutoff)[::-1]])
    own, ahead = F.floor(F.col(index) / (3 * block)), F.floor((F.col(index) + TAPS - 1) / (3 * block))
    spread = samples.select(F.col(session), F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("x"), F.explode(F.array_distinct(F.array(own, ahead))).alias("_b"))
    held = spread.groupBy(session, "_b").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_s"))
    # zeros stand for what comes before a session
    first, last = F.col("_b") * 3 * block, F.element_at("_s", -1)["i"]
    xs = F.concat(F.when(F.col("_b") == 0, F.array_repeat(F.lit(0.0), TAPS - 1)).otherwise(F.array().cast("array<double>")), F.transform("_s", lambda s: s["x"]))
    n = F.least(F.lit(block).cast("long"), F.floor((last + 1 - first) / 3))
    df = held.select(session, "_b", xs.alias("_x"), n.alias("_n")).where("_n > 0")
    product = lambda k: F.aggregate(F.zip_with(F.slice("_x", (3 * k + 1).cast("int"), F.lit(TAPS)), taps, lambda x, t: x * t), F.lit(0.0), lambda a, v: a + v)
    out = df.select(session, "_b", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), product)).alias("k", "y"))
    return out.select(session, (F.col("_b") * block + F.col("k")).alias("m"), "y")


def frame_energy(x: np.ndarray, hop: int) -> np.ndarray:
    """Root mean square of each whole frame."""
    return np.sqrt(np.square(x[: len(x) // hop * hop].reshape(-1, hop)).mean(axis=1, dtype=np.float32))


def energy_prob(energy: np.ndarray) -> np.ndarray:
    return np.clip((energy - FLOOR) / (CEILING - FLOOR), 0, 1)


def energy_probability(energy: Column) -> Column:
    """energy_prob() of a column."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (energy - FLOOR) / (CEILING - FLOOR)))


def tone(seconds: float, kind: str = "sine", seed: int = 0) -> np.ndarray:
    """A test clip; its seed shifts pitch and phase of a sine, or seeds the noise."""
    n = max(1, round(seconds * RATE))
    if kind == "silence":
        return np.zeros(n, np.float32)
    if kind == "noise":
        return (np.random.default_rng(seed or 1).standard_normal(n) * 0.02).astype(np.float32)
    if kind != "sine":
        raise ValueError(f"unknown kind: {kind}")
    return (0.05 * np.sin(2 * np.pi * (440 + seed % 200) * np.arange(n) / RATE + seed * 0.013 % (2 * np.pi))).astype(np.float32)


def float_to_pcm16(x: Column) -> Column:
    """A clipped sample as a 16-bit integer, negative ones scaled by one more."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.when(s < 0, s * 32768).otherwise(s * 32767).cast("int")


def native_vad_input(x: Column) -> Column:
    """A sample as a 16-bit integer for a native detector: clipped, scaled by 32,767 either way and cut, not rounded."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int")


def probability(value: Column) -> Column:
    """A detector's answer as a number in 0..1; nothing, or what isn't a number, is 0. Of a list, pass the first element."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def whole_hops(chunks: DataFrame, session: str, order: list[str], n_samples: Column, hop: int) -> DataFrame:
    """``chunks`` with ``first_hop`` and ``n_hops``, the hops that each completes, and ``carry``, the samples that it leaves for the next.

    Samples are counted over the session, so a hop may begin in one chunk and end in another.
    """
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = chunks.withColumn("_n", n_samples.cast("long")).withColumn("_end", F.sum("_n").over(w))
    first, last = F.floor((F.col("_end") - F.col("_n")) / hop), F.floor(F.col("_end") / hop)
    return df.withColumns({"first_hop": first, "n_hops": last - first, "carry": F.col("_end") % hop}).drop("_n", "_end")


def joined_pcm(frames: DataFrame, by: list[str], order: list[str], pcm: str = "pcm") -> DataFrame:
    """(by, pcm, n_frames): each group's samples in order, as one clip. A clip is one row, so groups are utterances or segments."""
    held = F.array_sort(F.collect_list(F.struct(*order, pcm)))
    return frames.where(F.col(pcm).isNotNull()).groupBy(*by).agg(held.alias("_f")).select(*by, F.aggregate("_f", F.lit(b""), lambda a, x: F.concat(a, x[pcm])).alias("pcm"), F.size("_f").alias("n_frames"))


def rms(values: Column) -> Column:
    """Root mean square of an array."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(values))


def decoder(cut: Callable[[bytes], bytes] | None = None):
    """A UDF: 16-bit mono samples at 16 kHz of a WAV file, their duration, or why there are none. ``cut`` shortens the samples in the same pass; the duration is that of all.

    It takes one clip at a time out of Arrow's column, and loads no pandas: there are as many workers as cores, and most
    of a worker's memory is what it has loaded.
    """

    @F.arrow_udf(DECODED)
    def decode(content: pa.Array) -> pa.Array:
        def one(data: bytes | None) -> tuple:
            try:
                x = read_wav(data or b"")
            except AudioError:
                return None, None, "decode_failed"
            pcm = to_pcm16(x)
            return pcm if cut is None else cut(pcm), len(x) / RATE, None

        pcm, seconds, error = zip(*[one(x.as_py()) for x in content], strict=True) if len(content) else ((), (), ())
        return pa.StructArray.from_arrays([binaries(pcm), doubles(seconds), strings(error)], ["pcm", "seconds", "error"])

    return decode


decode_wav = decoder()


@F.arrow_udf(T.BinaryType())
def encode_wav(pcm: pa.Array) -> pa.Array:
    """A WAV file of 16-bit samples at 16 kHz, scaled as floats in -1..1 are."""
    return binaries([wav(pcm16(x.as_py())) if x.is_valid else None for x in pcm])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def frame_probs(pcm: pa.Array) -> pa.Array:
    """Speech probability of each 10 ms frame, from its energy."""
    return lists([energy_prob(frame_energy(pcm16(x.as_py()), 160)).astype(float) if x.is_valid else np.zeros(0) for x in pcm])


def tail_cap_pcm(pcm: Column, seconds: float) -> Column:
    """The last ``seconds`` of 16-bit samples; all if the cap isn't positive."""
    size = 2 * int(RATE * seconds)
    return pcm if size <= 0 else F.when(F.octet_length(pcm) > size, F.substring(pcm, -size, size)).otherwise(pcm)

"""Baseline JPEG in numpy: markers, Huffman-coded scans and DC-only luminance thumbnails.

Scans are decoded in lock step: all restart intervals that share their tables advance one symbol at a
time, as numpy vectors. Payload images are grey, hold one byte of payload (plus one, so that it is never
zero) in each quantised coefficient, and restart after every block, so thousands of blocks advance at once.
An image of other origin with few restarts is decoded too, only more slowly.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Coefficient sizes in order of rising code length; 0 stands for the end of a block.
SIZE_ORDER = (7, 6, 8, 4, 0, 5, 9, 3, 2, 1)
#: A baseline frame's height is at most 65,535 samples.
MAX_ROWS = 8191
#: The luminance quantiser of payload images; only the thumbnail's contrast depends on it.
DC_QUANT = 4


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    interval: int = 0
    quant: dict = field(default_factory=dict)
    components: list = field(default_factory=list)  # (id, h, v, quantiser)
    huffman: dict = field(default_factory=dict)  # (class, id) -> (counts, symbols)
    scan: list = field(default_factory=list)  # (component index, DC table, AC table)
    data: tuple = (0, 0)


def parse(blob: bytes) -> Image:
    """Read all markers of a baseline file with one scan; raises ValueError for anything else."""
    if blob[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    image, at = Image(), 2
    while True:
        if blob[at] != 0xFF:
            raise ValueError("marker expected")
        marker, at = blob[at + 1], at + 2
        if marker == 0xFF:
            at -= 1
            continue
        (n,) = struct.unpack_from(">H", blob, at)
        body, at = blob[at + 2 : at + n], at + n
        if marker == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                image.quant[key] = np.frombuffer(body[1 : 1 + size], dtype=">u2" if wide else "u1").astype(np.int32)
                body = body[1 + size :]
        elif marker == 0xC0:
            precision, image.height, image.width, count = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("not 8 bits a sample")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                image.huffman[body[0] >> 4, body[0] & 15] = (counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            (image.interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(image.scan) != len(image.components):
                raise ValueError("more than one scan")
            image.data = (at, len(blob) - 2 if blob[-2:] == b"\xff\xd9" else len(blob))
            return image


@lru_cache(maxsize=64)
def lookup(counts: tuple, symbols: tuple) -> np.ndarray:
    """For each 16 bits: code length << 8 | symbol; 0 where no code begins so."""
    table, code, k = np.zeros(1 << 16, dtype=np.uint16), 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and where each restart interval begins in them."""
    ff = np.flatnonzero(data[:-1] == 0xFF) if len(data) > 1 else np.zeros(0, dtype=np.int64)
    after = data[ff + 1]
    keep = np.ones(len(data), dtype=bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep)
    return data[keep], np.concatenate(([0], place[marks]))


def decode_blocks(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, layout: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coefficients (all blocks, 64) in zigzag order. ``layout``: component, DC and AC lookup of an MCU's blocks in turn."""
    padded = np.concatenate((data, np.full(8, 0xFF, dtype=np.uint8))).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    coefficients = np.zeros((int(blocks.sum()), 64), dtype=np.int16)
    flat = coefficients.reshape(-1)
    position = starts.astype(np.int64) * 8
    previous = np.zeros((len(starts), 1 + max((c for c, _, _ in layout), default=0)), dtype=np.int32)
    last = len(window) - 1

    def symbol(table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = window[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint32)
        found = table[bits >> 16]
        length = (found >> 8).astype(np.int64)
        if not length.all():
            raise ValueError("damaged scan")
        size = found & 15
        used = length + size
        if used.max() > 25:
            q = p + length
            tail = window[np.minimum(q >> 3, last)] << (q & 7).astype(np.uint32)
        else:
            tail = bits << length.astype(np.uint32)
        size32 = size.astype(np.uint32)
        value = np.where(size > 0, tail >> ((32 - size32) & 31), 0).astype(np.int32)
        half = np.int32(1) << np.maximum(size.astype(np.int32) - 1, 0)
        value = np.where((value < half) & (size > 0), value - 2 * half + 1, value)
        return found & 255, value, p + used

    for b in range(int(blocks.max(initial=0))):
        component, dc, ac = layout[b % len(layout)]
        on = np.flatnonzero(blocks > b)
        base = (first[on] + b) * 64
        _, difference, p = symbol(dc, position[on])
        previous[on, component] += difference
        flat[base] = previous[on, component]
        k = np.zeros(len(on), dtype=np.int64)
        while len(on):
            code, value, p = symbol(ac, p)
            k += (code >> 4) + 1
            some = (code & 15) > 0
            ended = code == 0
            if some.all():
                flat[base + k] = value
            else:
                flat[(base + k)[some]] = value[some]
            done = ended | (k >= 63)
            if done.any():
                position[on[done]] = p[done]
                go = ~done
                on, base, k, p = on[go], base[go], k[go], p[go]
    return coefficients


def decode(blobs: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """Parse and decode baseline files: (image, coefficients in scan order). Files with like tables are decoded together."""
    images = [parse(b) for b in blobs]
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        layout = tuple((c, image.huffman[0, d], image.huffman[1, a]) for c, d, a in image.scan for _ in range(1 if len(image.scan) == 1 else image.components[c][1] * image.components[c][2]))
        groups.setdefault(layout, []).append(i)
    out: list = [None] * len(blobs)
    for layout, members in groups.items():
        datas, starts, blocks, owned, at = [], [], [], [], 0
        for i in members:
            image = images[i]
            data, start = intervals(np.frombuffer(blobs[i], dtype=np.uint8)[image.data[0] : image.data[1]])
            mcus = mcu_count(image)
            every = image.interval or mcus
            n = np.minimum(every, mcus - np.arange(len(start)) * every) * len(layout)
            if len(start) != -(-mcus // every):
                raise ValueError("restart markers are missing")
            datas.append(data)
            starts.append(start + at)
            blocks.append(n)
            owned.append(int(n.sum()))
            at += len(data)
        found = decode_blocks(np.concatenate(datas), np.concatenate(starts), np.concatenate(blocks), [(c, lookup(*d), lookup(*a)) for c, d, a in layout])
        for i, part in zip(members, np.split(found, np.cumsum(owned)[:-1]), strict=True):
            out[i] = (images[i], part)
    return out


def mcu_count(image: Image) -> int:
    if len(image.scan) == 1:
        return -(-image.width // 8) * -(-image.height // 8)
    h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    return -(-image.width // (8 * h)) * -(-image.height // (8 * v))


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size: each block's mean, from its DC coefficient alone."""
    c, h, v, q = image.components[image.scan[0][0]]
    scale = image.quant[q][0]
    if len(image.scan) == 1:
        dc = coefficients[:, 0].reshape(-1, -(-image.width // 8))
    else:
        per = sum(image.components[i][1] * image.components[i][2] for i, _, _ in image.scan)
        across = -(-image.width // (8 * max(x[1] for x in image.components)))
        dc = coefficients.reshape(-1, per, 64)[:, : h * v, 0].reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
        dc = dc[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip((dc.astype(np.int32) * scale + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 by 8 areas are lighter than their mean."""
    rows = np.arange(9) * thumb.shape[0] // 8
    cols = np.arange(9) * thumb.shape[1] // 8
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), dtype=np.int64)
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    top, left = rows[:-1], cols[:-1]
    bottom, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    area = total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]
    mean = area / ((bottom - top)[:, None] * (right - left)[None, :])
    return np.packbits(mean > mean.mean()).tobytes().hex()


@lru_cache(maxsize=1)
def payload_codes() -> tuple[np.ndarray, np.ndarray, bytes]:
    """For each byte its bits and their number; and the one Huffman table that DC and AC use."""
    codes = {s: ((1 << i + 1) - 2, i + 1) for i, s in enumerate(SIZE_ORDER)}
    words, lengths = np.zeros(257, dtype=np.uint64), np.zeros(257, dtype=np.uint32)
    for c in range(257):
        s = c.bit_length()
        words[c], lengths[c] = codes[s][0] << s | c, codes[s][1] + s
    table = bytes([1] * len(SIZE_ORDER) + [0] * (16 - len(SIZE_ORDER))) + bytes(SIZE_ORDER)
    return words, lengths, table


def encode(payloads: list[bytes], comments: list[bytes]) -> list[bytes]:
    """Grey baseline files that hold each payload (a positive multiple of 64 bytes) as quantised coefficients.

    A coefficient is the byte plus one; the blocks that fill up the last row of an image are all zero.
    """
    words, lengths, table = payload_codes()
    counts = np.array([len(p) // 64 for p in payloads])
    across = -(-counts // MAX_ROWS)
    down = -(-counts // across)
    blocks = across * down
    real = np.concatenate([np.arange(n) < c for n, c in zip(blocks, counts, strict=True)])
    value = np.zeros((len(real), 64), dtype=np.int16)
    value[real] = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, 64)
    value[real] += 1
    columns = np.ascontiguousarray(value.T)
    partial = not real.all()
    held, n = np.zeros(len(real), dtype=np.uint64), np.zeros(len(real), dtype=np.uint32)
    # a block's bits go to big-endian words of its own row, 32 at a time
    packed = np.zeros((len(real), 64 * 19 // 32 + 2), dtype=">u4")
    flat, at = packed.reshape(-1), np.arange(len(real)) * packed.shape[1]
    for j in range(64):
        size, word = lengths[columns[j]], words[columns[j]]
        if partial and j > 1:
            size, word = size * real, word * real
        held = held << size.astype(np.uint64) | word
        n += size
        full = np.flatnonzero(n >= 32)
        n[full] -= 32
        flat[at[full]] = (held[full] >> n[full]).astype(np.uint32)
        at[full] += 1
    # the last bits, and ones up to a whole byte
    pad = (-n) & 7
    held = held << pad.astype(np.uint64) | ((1 << pad) - 1).astype(np.uint64)
    n += pad
    flat[at] = (held << (32 - n).astype(np.uint64) & 0xFFFFFFFF).astype(np.uint32)
    used = (at - np.arange(len(real)) * packed.shape[1]) * 4 + (n >> 3).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(used)[:-1]))
    stream = packed.view(np.uint8).reshape(len(real), -1)[np.arange(packed.shape[1] * 4) < used[:, None]]
    ff = stream == 0xFF
    moved = np.cumsum(ff) - ff
    block_of = np.zeros(len(stream), dtype=np.int64)
    block_of[first[1:]] = 1
    block_of = np.cumsum(block_of)
    doc_first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    within = np.arange(len(real)) - np.repeat(doc_first, blocks)
    final = np.zeros(len(real), dtype=bool)
    final[np.cumsum(blocks) - 1] = True
    marks = np.cumsum(~final) - ~final
    out = np.zeros(len(stream) + int(ff.sum()) + 2 * int((~final).sum()), dtype=np.uint8)
    out[np.arange(len(stream)) + moved + 2 * marks[block_of]] = stream
    tail = first + used - 1
    close = tail + moved[tail] + ff[tail] + 2 * marks + 1
    inner = ~final
    out[close[inner]] = 0xFF
    out[close[inner] + 1] = 0xD0 + within[inner] % 8
    stops = close[final]
    made, at = [], 0
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    quant = segment(0xDB, bytes([0, DC_QUANT] + [1] * 63))
    huffman = segment(0xC4, bytes([0x00]) + table + bytes([0x10]) + table)
    tables = huffman + segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    for comment, w, h, stop in zip(comments, across, down, stops, strict=True):
        frame = segment(0xC0, struct.pack(">BHHB", 8, int(h) * 8, int(w) * 8, 1) + bytes([1, 0x11, 0]))
        made.append(b"".join((b"\xff\xd8", segment(0xFE, comment), quant, frame, tables, out[at:stop].tobytes(), b"\xff\xd9")))
        at = int(stop)
    return made


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    real = coefficients[:, 0] > 0
    return (coefficients[real] - 1).astype(np.uint8).tobytes()

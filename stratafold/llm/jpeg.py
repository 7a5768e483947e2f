"""Baseline JPEG media columns in numpy.

:func:`thumbnails` parses the markers of baseline JPEG files, Huffman-decodes their scans and rebuilds the DC-only luminance
thumbnail (one pixel for each 8x8 block).  Restart intervals are independent, so the intervals of all files of a batch that share
their tables are decoded side by side, one block a step.  :func:`encode` is the inverse for grey thumbnails: every sample becomes
the DC coefficient of a block, so a thumbnail gives back the stored samples exactly.  Any byte string is stored that
way by :func:`media`.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Payload unit, blocks a row for payloads up to NARROW_MOST bytes and beyond, most block rows, blocks of a restart interval.
UNIT, NARROW, WIDE, MOST_ROWS, INTERVAL = 576, 24, 576, 8191, 72
NARROW_MOST = NARROW * MOST_ROWS // UNIT * UNIT
#: Payload bytes handled side by side.
SLICE = 1 << 20
#: Table K.3 of the JPEG standard (code counts by length, symbols) and an AC table with the end-of-block code alone.
DC_BITS, DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
AC_BITS, AC_SYMBOLS = bytes([1, *[0] * 15]), bytes([0])


def _codes(bits: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """Canonical Huffman codes: (symbol, code, length)."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@functools.lru_cache(4096)
def _header(wide: int, high: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, bytes([0]) + bytes([8] * 64)),
        _segment(0xC0, bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + DC_BITS + DC_SYMBOLS),
        _segment(0xC4, bytes([0x10]) + AC_BITS + AC_SYMBOLS),
        _segment(0xDD, INTERVAL.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


@functools.cache
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Code (with end-of-block) and length for each DC difference + 256."""
    codes = {s: (c, n) for s, c, n in _codes(DC_BITS, DC_SYMBOLS)}
    value, length = np.zeros(512, np.uint32), np.zeros(512, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 256] = ((c << size | extra) << 1) & 0xFFFFFF
        length[d + 256] = n + size + 1
    return value, length


def _tiles(n: int) -> list[tuple[int, int]]:
    """Images for a payload of n bytes, as (blocks a row, rows)."""
    if n <= NARROW_MOST:
        return [(NARROW, n // NARROW)]
    rows = n // WIDE
    return [(WIDE, min(MOST_ROWS, rows - k)) for k in range(0, rows, MOST_ROWS)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of ``UNIT`` bytes) as one JPEG file, or several in a row beyond a file's size."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    tiles = [t for p in payloads for t in _tiles(len(p))]
    lanes = np.concatenate([np.full(w * h // INTERVAL, INTERVAL, np.int64) for w, h in tiles])
    first = np.concatenate(([0], np.cumsum(lanes)[:-1]))
    diff = np.diff(samples, prepend=np.int16(0))
    diff[first] = samples[first]
    value, length = _encoder()
    code, bits = value[diff + 256], length[diff + 256].astype(np.int64)
    done = np.cumsum(bits)
    ends = done[first + lanes - 1]
    begins = np.concatenate(([0], ends[:-1]))
    sizes = -(-(ends - begins) // 8)
    at = np.concatenate(([0], np.cumsum(sizes)))
    place = done - bits + np.repeat(8 * at[:-1] - begins, lanes)
    byte = place >> 3
    placed = code.astype(np.int64) << (24 - (place & 7) - bits)
    cut = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    total, own = np.add.reduceat(placed, cut), byte[cut]
    raw = np.zeros(int(at[-1]) + 3, np.uint8)
    for k, shift in enumerate((16, 8, 0)):
        raw[own + k] += ((total >> shift) & 255).astype(np.uint8)
    last = at[1:] - 1
    raw[last] |= ((1 << (8 * sizes - (ends - begins))) - 1).astype(np.uint8)
    raw = raw[: int(at[-1])]
    # Stuffing, and a marker after each interval: RSTn, or EOI after a file's last.
    wide = 1 + (raw == 255).astype(np.int64)
    lane = np.repeat(np.arange(len(lanes)), sizes)
    to = np.cumsum(wide) - wide + 2 * lane
    out = np.zeros(int(wide.sum()) + 2 * len(lanes), np.uint8)
    out[to] = raw
    stop = to[last] + wide[last]
    counts = np.array([w * h // INTERVAL for w, h in tiles])
    within = np.arange(len(lanes)) - np.repeat(np.cumsum(counts) - counts, counts)
    marker = 0xD0 + within % 8
    final = np.cumsum(counts) - 1
    marker[final] = 0xD9
    out[stop], out[stop + 1] = 255, marker
    bounds = np.concatenate(([0], stop[final] + 2))
    files = [_header(*t) + out[bounds[i] : bounds[i + 1]].tobytes() for i, t in enumerate(tiles)]
    result, k = [], 0
    for p in payloads:
        n = len(_tiles(len(p)))
        result.append(b"".join(files[k : k + n]))
        k += n
    return result


@dataclass
class Image:
    """One baseline file: size, luminance quantiser, blocks of an MCU, tables, scan bytes."""

    wide: int
    high: int
    quant: int
    blocks: tuple[tuple[int, bytes, bytes], ...]  # (is luminance, DC table, AC table) of an MCU's blocks, in order
    sampling: tuple[int, int]
    grid: tuple[int, int]
    interval: int
    scan: tuple[int, int]
    end: int


def parse(data: bytes, start: int = 0) -> Image:
    """Markers of the baseline file at ``start``; raises ValueError where it is none."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, quants, tables, frame, interval = start + 2, {}, {}, None, 0
    while True:
        if at + 4 > len(data) or data[at] != 255:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 255:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                step = 2 if body[k] >> 4 else 1
                quants[body[k] & 15] = int.from_bytes(body[k + 1 : k + 1 + step], "big")
                k += 1 + 64 * step
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xC0:
            frame = (int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])])
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            parts = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            stop = at
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    raise ValueError("scan without an end")
                if data[stop + 1] and not 0xD0 <= data[stop + 1] <= 0xD7:
                    break
                stop += 2
            if frame is None:
                raise ValueError("scan without a frame")
            if frame[2][0][0] in parts:
                break
            at = stop  # a scan of other components
    high, wide, comps = frame
    luma = comps[0]
    used = [c for c in comps if c[0] in parts]
    most = (max(c[1] >> 4 for c in comps), max(c[1] & 15 for c in comps))
    blocks = []
    for c in used:
        n = 1 if len(used) == 1 else (c[1] >> 4) * (c[1] & 15)
        t = parts[c[0]]
        blocks += [(int(c is luma), tables[t >> 4], tables[16 + (t & 15)])] * n
    if len(used) == 1:
        sampling = (1, 1)
        mcu = (8 * most[0] // (luma[1] >> 4), 8 * most[1] // (luma[1] & 15))
    else:
        sampling, mcu = (luma[1] >> 4, luma[1] & 15), (8 * most[0], 8 * most[1])
    grid = (-(-wide // mcu[0]), -(-high // mcu[1]))
    end = data.find(b"\xff\xd9", stop)
    return Image(wide, high, quants[luma[2]], tuple(blocks), sampling, grid, interval, (at, stop), (end if end >= 0 else stop) + 2)


@functools.lru_cache(64)
def _lookup(dc: bytes, ac: bytes) -> tuple[np.ndarray, ...]:
    """By the next 16 bits: DC length, size; AC length, run and size; and, where difference and end-of-block fit in them, both at once."""
    def table(t: bytes) -> tuple[np.ndarray, np.ndarray]:
        symbol, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        for s, c, n in _codes(t[:16], t[16:]):
            symbol[c << 16 - n : (c + 1) << 16 - n] = s
            length[c << 16 - n : (c + 1) << 16 - n] = n
        return symbol, length

    size, n = table(dc)
    run, m = table(ac)
    word = np.arange(1 << 16, dtype=np.int64)
    extra = word >> np.clip(16 - n - size, 0, 16) & ((1 << np.clip(size, 0, 16)) - 1)
    diff = np.where(size == 0, 0, np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << np.clip(size, 0, 16)) + 1))
    rest = (word << np.clip(n + size, 0, 16)) & 0xFFFF
    all_bits = n + size + m[rest]
    fused = (n > 0) & (m[rest] > 0) & (run[rest] == 0) & (all_bits <= 16)
    return size, n, run, m, np.where(fused, all_bits | (diff + (1 << 20)) << 8, 0)


def _decode(buffer: np.ndarray, starts: np.ndarray, mcus: np.ndarray, blocks: tuple[tuple[int, bytes, bytes], ...]) -> np.ndarray:
    """Luminance DC values (lane, MCU x block) of intervals that begin at byte ``starts`` of the unstuffed buffer."""
    lumas = sum(b[0] for b in blocks)
    order = np.argsort(-mcus, kind="stable")
    pos, count = starts[order].astype(np.int64) * 8, mcus[order]
    padded = np.concatenate((buffer, np.full(8, 255, np.uint8))).astype(np.uint32)
    word = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    limit = len(word) - 1
    out = np.zeros((int(count[0]) * lumas, len(order)), np.int32)
    kinds = {b[1:]: _lookup(*b[1:]) for b in blocks}
    luma = np.zeros(len(order), np.int64)
    alive, shift16 = len(order), np.int64(16)
    for step in range(int(count[0])):
        while alive and count[alive - 1] <= step:
            alive -= 1
        p = pos[:alive]
        row = step * lumas
        for is_luma, dc, ac in blocks:
            size, n, run, m, fused = kinds[dc, ac]
            w = (word[np.minimum(p >> 3, limit)] >> (shift16 - (p & 7))) & 0xFFFF
            both = fused[w]
            slow = np.flatnonzero(both == 0)
            p += both & 255
            diff = (both >> 8) - (1 << 20)
            if len(slow):
                q, w = p[slow], w[slow]
                if (n[w] == 0).any():
                    raise ValueError("no such DC code")
                q += n[w]
                s = size[w]
                x = (word[np.minimum(q >> 3, limit)].astype(np.int64) >> (32 - (q & 7) - s)) & ((1 << s) - 1)
                diff[slow] = np.where(s == 0, 0, np.where(x >> np.maximum(s - 1, 0) & 1, x, x - (1 << s) + 1))
                q += s
                k, going = np.zeros(len(q), np.int64), np.arange(len(q))
                while len(going):
                    at = q[going]
                    w = (word[np.minimum(at >> 3, limit)] >> (shift16 - (at & 7))) & 0xFFFF
                    if (m[w] == 0).any():
                        raise ValueError("no such AC code")
                    symbol = run[w]
                    q[going] = at + m[w] + (symbol & 15)
                    k[going] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
                    going = going[k[going] < 63]
                p[slow] = q
            if is_luma:
                luma[:alive] += diff
                out[row, :alive] = luma[:alive]
                row += 1
    result = np.zeros((len(order), out.shape[0]), np.int32)
    result[order] = out.T
    return result


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each byte string, of each JPEG file in it: width, height, and the DC-only luminance thumbnail (uint8)."""
    images: list[tuple[int, Image]] = []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            images.append((i, image := parse(data, at)))
            at = image.end
    out: list[list] = [[] for _ in files]
    thumbs: dict[int, tuple] = {}
    same: dict[tuple, list[int]] = {}
    for j, (_, image) in enumerate(images):
        same.setdefault(image.blocks, []).append(j)
    for blocks, group in same.items():
        raw = np.frombuffer(b"".join(files[images[j][0]][slice(*images[j][1].scan)] + b"\xff\xd0" for j in group), np.uint8)
        mark = np.flatnonzero(raw[:-1] == 255)
        follows = raw[mark + 1]
        stuffed, restart = mark[follows == 0] + 1, mark[(follows >= 0xD0) & (follows <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[stuffed] = keep[restart] = keep[restart + 1] = False
        clean = raw[keep]
        ends = np.cumsum(keep)[restart]
        starts = np.concatenate(([0], ends[:-1]))
        total = np.array([images[j][1].grid[0] * images[j][1].grid[1] for j in group])
        step = np.array([images[j][1].interval or t for j, t in zip(group, total, strict=True)])
        lanes = -(-total // step)
        if lanes.sum() != len(starts):
            raise ValueError("restart intervals do not fit the image")
        at = np.arange(len(starts)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        mcus = np.minimum(np.repeat(step, lanes), np.repeat(total, lanes) - at * np.repeat(step, lanes))
        values = _decode(clean, starts, mcus, blocks)
        lumas, lane = sum(b[0] for b in blocks), 0
        for j, n, count, each in zip(group, lanes, total, step, strict=True):
            image = images[j][1]
            own = values[lane : lane + n, : each * lumas].reshape(-1)[: count * lumas]
            lane += n
            h, v = image.sampling
            grid = own.reshape(image.grid[1], image.grid[0], v, h).transpose(0, 2, 1, 3).reshape(image.grid[1] * v, image.grid[0] * h)
            pixels = np.clip((grid.astype(np.int64) * image.quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
            thumbs[j] = (image.wide, image.high, pixels[: -(-image.high // 8), : -(-image.wide // 8)])
    for j, (i, _) in enumerate(images):
        out[i].append(thumbs[j])
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit average hash of a thumbnail: which of 8x8 cells lie above the mean; small thumbnails repeat their edge."""
    h, w = (max(8, n) for n in thumb.shape)
    t = np.pad(thumb, ((0, h - thumb.shape[0]), (0, w - thumb.shape[1])), "edge").astype(np.int64)
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    sums = np.add.reduceat(np.add.reduceat(t, rows, axis=0), cols, axis=1)
    area = np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))
    cells = sums / area
    return np.packbits(cells > cells.mean()).tobytes().hex()


def payload(text: bytes) -> bytes:
    """The bytes, filled with 255 to a positive multiple of ``UNIT``."""
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def _media(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = [(t or "").encode() for t in batch["text"].to_pylist()]
    for ids, own in _runs(batch["id"], texts):
        padded = [payload(t) for t in own]
        stored = encode(padded)
        read = thumbnails(stored)
        back = [b"".join(t.tobytes() for _, _, t in images) for images in read]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
                pa.array([len(s) for s in stored], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in stored]),
                pa.array([f"{images[0][0]}x{sum(i[1] for i in images)}:{thumbnail_hash(np.vstack([i[2] for i in images]))}" for images in read]),
                pa.array(stored, pa.binary()),
            ],
            ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"],
        )


def _runs(ids: pa.Array, texts: list[bytes]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + UNIT
        if held >= SLICE or i + 1 == len(texts):
            yield ids.slice(first, i + 1 - first), texts[first : i + 1]
            first, held = i + 1, 0


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its UTF-8 bytes (null: none) stored as JPEG samples in ``media``, and what reading them back gives:
    lengths, digests and ``feature``, width x height and average hash of the thumbnail; the files of a very long text, of equal width, are
    one image.  Repeated rows are stored each; an empty table gives no rows."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = map_arrow(source, _media, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")
    return out.withColumnRenamed("id", id_col)

"""GIF media columns: LZW streams, palettes, disposal and transparency, timed frames with colour histograms.

``frames`` reads any GIF87a/89a file frame by frame: global and local palettes, interlaced images, graphic control
(delay, transparent index, disposal 0 to 3), LZW streams of any code width through the string table. ``encode`` writes
such streams: codes grow with the table up to 12 bits, and a clear code starts a new table when it is full. Loops run over bytes
and codes; bits are packed and unpacked by array operations, some thousand codes at a time, since a code's width follows from its
place behind the last clear code.

Defined results: a null or undecodable file gives null frames and the reason in ``error``; a file cut off
inside an image is undecodable. Payloads are the UTF-8 bytes (null: none) padded with zero bytes to a
positive multiple of 64; any length is stored, in frames of at most ``ROWS`` rows, one of which is held at a time. Rows are
independent, so repeated rows give equal results and an empty table an empty one; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 64
ROWS = 1024
DELAY_CS = 10
BINS = 8
FULL = 1 << 12
CODES_AT_ONCE = 1 << 12
FRAMES = "array<struct<start_ms:long,delay_ms:int,left:int,top:int,width:int,height:int,hist:array<long>>>"


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # palette indexes, height x width
    palette: np.ndarray  # colours, n x 3
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray | None = None  # composed RGBA


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


# ---------------------------------------------------------------- LZW


@cache
def _template(size: int) -> np.ndarray:
    """Bits of the codes behind a clear code, as the reader's table then asks for, until they stay at 12."""
    entries = np.arange(FULL) + (1 << size) + 1
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))


def _widths(first: int, n: int, size: int) -> np.ndarray:
    """Bits of the codes ``first``, ``first`` + 1, .. behind a clear code."""
    known = _template(size)[first : first + n]
    return known if len(known) == n else np.concatenate((known, np.full(n - len(known), 12)))


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as bits, lowest first."""
    ends = np.cumsum(widths)
    at = ends - widths
    byte, value, size = at >> 3, codes << (at & 7), int(ends[-1] + 7 >> 3)
    # no two codes share a bit, so sums are unions
    return sum(np.bincount(byte + k, value >> 8 * k & 255, size + 2) for k in range(3)).astype(np.uint8)[:size].tobytes()


def _unpacked(data: np.ndarray, at: int, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole codes from bit ``at`` on that have these widths, and the place behind each; data: the bytes and two more."""
    ends = at + np.cumsum(widths)
    ends = ends[: np.searchsorted(ends, 8 * (len(data) - 2), "right")]
    widths = widths[: len(ends)]
    start = ends - widths
    byte = start >> 3
    return (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (start & 7) & (1 << widths) - 1, ends


def _strings(codes: np.ndarray, size: int, before: np.ndarray) -> np.ndarray:
    """The samples of the codes behind one clear code. ``before`` are codes behind it that were read earlier.

    The table's entry m is the string of code m and its successor's first sample, so it stands in the output where code m
    starts; each sample of a table code points to the sample that it repeats, and pointers are followed to a literal.
    """
    every = np.concatenate((before, codes)) if len(before) else codes
    base, place = (1 << size) + 2, np.arange(len(every))
    entry = every - base
    literal = entry < 0
    if (every[literal] >= 1 << size).any() or (entry >= np.minimum(place, FULL - base)).any():
        raise ValueError("code without an entry")
    parent, length = np.where(literal, place, entry), np.ones(len(every), np.int64)
    step, count = parent, (~literal).astype(np.int64)
    while True:  # a code's length is 1 more than its parent's: doubling
        more = count[step]
        if not more.any():
            break
        count, step = count + more, step[step]
    length += count
    start = np.cumsum(length) - length
    of = np.repeat(place, length)
    inside = np.arange(len(of)) - start[of]
    source = start[parent[of]] + inside
    # the last sample of a code that repeats its predecessor's entry lies in the code itself, still before its own place
    while True:
        again = source[source]
        if (again == source).all():
            break
        source = again
    out = every[of[source]].astype(np.uint8)
    return out[start[len(before)] :] if len(before) < len(every) else out[:0]


def lzw_decode(data: bytes, size: int, n: int) -> np.ndarray:
    """``n`` samples of a code stream; raises ValueError if it is broken or short."""
    clear, stop = 1 << size, (1 << size) + 1
    bits = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int64)
    # codes behind the last clear code that later ones may refer to: as many as a table has entries
    before, out, made, at, since = np.zeros(0, np.int64), [], 0, 0, 0
    while made < n:
        codes, ends = _unpacked(bits, at, _widths(since, min(CODES_AT_ONCE, 8 * len(data) // (size + 1) + 1), size))
        if not len(codes):
            raise ValueError("code stream ends early")
        special = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(special[0]) if len(special) else len(codes)
        out.append(_strings(codes[:upto], size, before))
        made += len(out[-1])
        if upto == len(codes):
            at, since, before = int(ends[-1]), since + len(codes), np.concatenate((before, codes))[:FULL]
        elif codes[upto] == stop:
            break
        else:
            at, since, before = int(ends[upto]), 0, before[:0]
    if made < n:
        raise ValueError("code stream ends early")
    return np.concatenate(out)[:n] if out else np.zeros(0, np.uint8)


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """A code stream of the samples, each below 2 ** size: the longest known string each time, tables up to 4096 entries."""
    clear = 1 << size
    table: dict[int, int] = {}
    codes, starts, free = [clear], [1], clear + 2
    get, put, samples = table.get, codes.append, iter(samples)
    word = next(samples, -1)
    for sample in samples:
        key = word << 8 | sample
        code = get(key)
        if code is not None:
            word = code
            continue
        put(word)
        word = sample
        if free < FULL:
            table[key] = free
            free += 1
        else:
            put(clear)
            starts.append(len(codes))
            table, free = {}, clear + 2
            get = table.get
    if word >= 0:
        put(word)
    put(clear + 1)
    starts.append(len(codes))
    return _packed(np.array(codes, np.int64), np.concatenate([[size + 1], *(_widths(0, b - a, size) for a, b in zip(starts[:-1], starts[1:], strict=True))]))


# ---------------------------------------------------------------- files


def _blocks(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    full = len(a) // 255
    out = np.full((full, 256), 255, np.uint8)
    out[:, 1:] = a[: full * 255].reshape(full, 255)
    rest = a[full * 255 :].tobytes()
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode(samples: np.ndarray, *, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A grey-scale GIF of the 8-bit samples (a multiple of ``width``), in frames of at most ``rows`` rows."""
    height = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), _GREY]
    for at in range(0, height, rows):
        h = min(rows, height - at)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, h, 0) + b"\x08")
        out.append(_blocks(lzw_encode(samples[at * width : (at + h) * width].tobytes())))
    return b"".join([*out, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        if at + 1 + n > len(data):
            raise ValueError("file ends early")
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    n = 3 << ((packed & 7) + 1)
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def decode(data: bytes) -> Gif:
    """All frames of a file; raises ValueError if it isn't whole."""
    seen = list(frames(data))
    width, height = struct.unpack("<HH", data[6:10])
    return Gif(width, height, seen)


def frames(data: bytes) -> Iterator[Frame]:
    """A file's frames, each composed on what its predecessors leave; raises ValueError if the file isn't whole."""
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("file ends early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, packed, _, _ = struct.unpack("<HHBBB", data[6:13])
    common, at = _palette(data, 13, packed) if packed & 0x80 else (None, 13)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, cs, index = struct.unpack("<BHB", body[:4])
                delay, disposal, transparent = cs * 10, flags >> 2 & 7, index if flags & 1 else None
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            own, at = _palette(data, at + 10, packed) if packed & 0x80 else (common, at + 10)
            if own is None:
                raise ValueError("no palette")
            size = data[at]
            if not 2 <= size <= 8:
                raise ValueError("bad code size")
            body, at = _sub_blocks(data, at + 1)
            samples = lzw_decode(body, size, w * h).reshape(h, w)
            if packed & 0x40:
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            frame = Frame(left, top, samples, own, delay, disposal, transparent)
            canvas = _composed(frame, canvas)
            yield frame
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")


def _composed(f: Frame, canvas: np.ndarray) -> np.ndarray:
    """Fill in the frame's canvas, what is seen while it shows; returns what it leaves to the next."""
    height, width = canvas.shape[:2]
    f.canvas = canvas.copy()
    h, w = max(0, min(f.samples.shape[0], height - f.top)), max(0, min(f.samples.shape[1], width - f.left))
    part = f.samples[:h, :w]
    colours = np.zeros((256, 4), np.uint8)
    colours[: len(f.palette), :3] = f.palette
    colours[:, 3] = 255
    spot = f.canvas[f.top : f.top + h, f.left : f.left + w]
    if f.transparent is None:
        spot[...] = colours[part]
    else:
        drawn = part != f.transparent
        spot[drawn] = colours[part[drawn]]
    if f.disposal == 3:
        return canvas
    if f.disposal == 2:
        canvas = f.canvas.copy()
        canvas[f.top : f.top + h, f.left : f.left + w] = 0
        return canvas
    return f.canvas


_CHANNELS = np.arange(3, dtype=np.uint8) * BINS


def histogram(frame: Frame) -> list[int]:
    """Counts of the composed frame's visible pixels by 3 x BINS channel bins: red, green, blue."""
    pixels = frame.canvas.reshape(-1, 4)
    seen = pixels if pixels[:, 3].all() else pixels[pixels[:, 3] > 0]
    return np.bincount((seen[:, :3] // (256 // BINS) + _CHANNELS).reshape(-1), minlength=3 * BINS).tolist()


def media_columns(df: DataFrame, column: str = "gif") -> DataFrame:
    """``df`` with gif_frames (timed frames with colour histograms) and error; replaces columns so called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for x in b.column(0):
                try:
                    if not x.is_valid:
                        raise ValueError("null")
                    start, rows = 0, []
                    for f in frames(x.as_py()):
                        rows.append({"start_ms": start, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.samples.shape[1], "height": f.samples.shape[0], "hist": histogram(f)})
                        start += f.delay_ms
                    found.append(rows)
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
            kind = pa.list_(pa.struct([("start_ms", pa.int64()), *((k, pa.int32()) for k in ("delay_ms", "left", "top", "width", "height")), ("hist", pa.list_(pa.int64()))]))
            rest = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, kind), pa.array(errors, pa.string())], [*b.schema.names[1:], "gif_frames", "error"])

    keep = [c for c in df.columns if c not in ("gif_frames", "error")]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"gif_frames {FRAMES}", "error string"])
    return df.select(F.col(column).alias("_gif"), *keep).mapInArrow(run, schema)


# ---------------------------------------------------------------- the stored payload


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def stored(text: str | None) -> tuple:
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the file read back.

    feature: size, number of frames and time, and the histogram of all composed frames' colours.
    """
    data = payload(text)
    media = encode(np.frombuffer(data, np.uint8))
    width, height = struct.unpack("<HH", media[6:10])
    read, size, tail, shown, lasts, colours = hashlib.sha256(), 0, b"", 0, 0, np.zeros(3 * BINS, np.int64)
    for f in frames(media):
        raw = f.samples.tobytes()
        read.update(raw)
        size, tail, shown, lasts, colours = size + len(raw), raw[-WIDTH:], shown + 1, lasts + f.delay_ms, colours + histogram(f)
    feature = f"{width}x{height}x{shown}@{lasts}:" + "-".join(map(str, colours.tolist()))
    n = len((text or "").encode("utf-8", "surrogatepass"))
    return n, size, read.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [stored(t.as_py()) for t in b.column(1)]
            cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""GIF media columns: an encoder that stores bytes as timed frames, and a decoder for GIF files in general.

The format is the published GIF89a. The decoder reads global and local colour
tables, interlaced images, the graphic control extension (delay, transparency,
disposal 0 to 3) and sub-blocks, decodes the LZW code streams, and composes the
frames on the canvas.
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

from quadrille.llm.common import ship

#: A payload is filled up to a multiple of this many bytes with FILL.
UNIT = 576
FILL = 255
#: Frame geometry: WIDTH columns, at most ROWS rows.
WIDTH = 24
ROWS = 384
DELAY_MS = 100
#: Bins of the colour histograms, for each of red, green and blue.
BINS = 8

_FULL = 4096


@functools.lru_cache(64)
def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of the codes that follow a clear code: the decoder's next free code must fit."""
    first = (1 << bits) + 1
    return np.minimum(12, np.frexp((first + np.arange(n)).astype(np.float64))[1]).astype(np.int64)


def lzw_codes(data: bytes, bits: int = 8) -> list[int]:
    """The codes of data, with clear codes where the table is full, and the end code."""
    clear = 1 << bits
    out = [clear]
    if not data:
        return [clear, clear + 1]
    emit = out.append
    table: dict[int, int] = {}
    get = table.get
    free = clear + 2
    at = iter(data)
    current = next(at)
    for b in at:
        key = current << 8 | b
        found = get(key)
        if found is not None:
            current = found
            continue
        emit(current)
        current = b
        if free == _FULL:
            emit(clear)
            table.clear()
            free = clear + 2
        else:
            table[key] = free
            free += 1
    emit(current)
    emit(clear + 1)
    return out


def pack_codes(codes: list[int], bits: int = 8) -> bytes:
    """Codes as a little-endian bit stream of growing code sizes."""
    c = np.array(codes, np.int64)
    starts = np.flatnonzero(c == 1 << bits)
    position = np.arange(len(c)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(c)), "left") - 1, 0)] - 1
    table = np.r_[bits + 1, _widths(int(position.max()) + 1 if len(c) else 0, bits)]
    width = table[np.maximum(position, -1) + 1]
    end = np.cumsum(width)
    offset = end - width
    value = c << (offset & 7)
    at = offset >> 3
    size = int(end[-1] + 7) >> 3
    out = np.zeros(size + 3, np.int64)
    for k in range(3):
        out[: size + 3] += np.bincount(at + k, (value >> (8 * k)) & 255, size + 3).astype(np.int64)
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Decode a code stream; at most `most` bytes."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    total = len(stream) * 8
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size, offset = 0, 0
    done = False
    span = 1024
    while not done and offset + bits + 1 <= total and size < most:
        # All codes up to the next clear or end code, whose sizes follow from their order alone.
        while True:
            width = _widths(span, bits)
            offsets = offset + np.cumsum(width) - width
            inside = offsets + width <= total
            width, offsets = width[inside], offsets[inside]
            at = offsets >> 3
            codes = ((raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16) >> (offsets & 7)) & ((1 << width) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or not inside.all():
                break
            span *= 4
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop < len(codes):
            done = codes[stop] == end
            offset = int(offsets[stop] + width[stop])
        else:
            done = True
        part = codes[:stop].tolist()
        if not part:
            continue
        table = singles.copy()
        grow, emit = table.append, out.append
        last = table[part[0]]
        emit(last)
        count = len(table)
        for code in part[1:]:
            if code < count:
                entry = table[code]
            elif code == count:
                entry = last + last[:1]
            else:
                raise ValueError("broken LZW stream")
            if count < _FULL:
                grow(last + entry[:1])
                count += 1
            emit(entry)
            last = entry
        size += sum(map(len, out[-len(part) :]))
    return b"".join(out)[:most]


@dataclass
class Frame:
    """One image of a file: its place, its palette indices, and how it is shown."""

    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


@functools.cache
def palette() -> np.ndarray:
    """256 different colours: the bits of an index spread over red (3), green (3) and blue (2)."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, ((i >> 2) & 7) * 255 // 7, (i & 3) * 85], 1).astype(np.uint8)


def store(payload: bytes) -> bytes:
    """A GIF of frames of WIDTH columns that holds payload as palette indices, without loss.

    The fill byte is the transparent colour. Frames are left in place, but every
    fourth restores the background and every fourth the frame before.
    """
    step = WIDTH * ROWS
    height = min(ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\x00\x00", palette().tobytes()]
    for k, a in enumerate(range(0, len(payload), step)):
        part = payload[a : a + step]
        disposal = (1, 1, 2, 3)[k % 4]
        out.append(b"\x21\xf9\x04" + bytes([disposal << 2 | 1]) + (DELAY_MS // 10).to_bytes(2, "little") + bytes([FILL, 0]))
        out.append(b"\x2c" + bytes(4) + WIDTH.to_bytes(2, "little") + (len(part) // WIDTH).to_bytes(2, "little") + b"\0\x08")
        out.append(_sub_blocks(pack_codes(lzw_codes(part))))
    out.append(b"\x3b")
    return b"".join(out)


def _deinterlaced(indices: bytes, width: int, height: int) -> bytes:
    rows = np.frombuffer(indices.ljust(width * height, b"\0"), np.uint8).reshape(height, width)
    order = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
    out = np.empty_like(rows)
    out[order] = rows
    return out.tobytes()


def load(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames of a GIF file."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    flags, at = data[10], 13

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 3 << ((flags & 7) + 1)
        return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    shared = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        shared, at = colours(flags, at)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                delay, disposal = int.from_bytes(body[1:3], "little") * 10, body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h = (int.from_bytes(data[at + 1 + 2 * k : at + 3 + 2 * k], "little") for k in range(4))
            flags, at = data[at + 9], at + 10
            own = shared
            if flags & 0x80:
                own, at = colours(flags, at)
            bits = data[at]
            body, at = blocks(at + 1)
            indices = lzw_decode(body, bits, w * h)
            if flags & 0x40:
                indices = _deinterlaced(indices, w, h)
            frames.append(Frame(left, top, w, h, indices, own, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("broken GIF")
    return width, height, frames


def _composed(width: int, height: int, frames: list[Frame], values: list[np.ndarray], empty: np.ndarray) -> Iterator[np.ndarray]:
    """The canvas as each frame shows it. values[k] has frame k's value of each palette index; `empty` is the background's."""
    canvas = np.empty((height, width, *empty.shape), empty.dtype)
    canvas[:] = empty
    for f, value in zip(frames, values, strict=True):
        before = canvas.copy() if f.disposal == 3 else None
        index = np.frombuffer(f.indices.ljust(f.width * f.height, b"\0"), np.uint8).reshape(f.height, f.width)
        place = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        index = index[: place.shape[0], : place.shape[1]]
        if len(value) < 256:
            index = np.minimum(index, len(value) - 1)
        if f.transparent is None:
            place[:] = value[index]
        else:
            seen = index != f.transparent
            place[seen] = value[index[seen]]
        yield canvas
        if f.disposal == 2:
            place[:] = empty
        elif f.disposal == 3:
            canvas = before


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    """(delay_ms, canvas) of each frame as shown; canvas: height x width x (red, green, blue, shown)."""
    colours = [np.concatenate([f.palette, np.full((len(f.palette), 1), 255, np.uint8)], 1) for f in frames]
    for f, canvas in zip(frames, _composed(width, height, frames, colours, np.zeros(4, np.uint8)), strict=False):
        yield f.delay_ms, canvas


def histograms(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """For each frame as shown: 3 x BINS, how many pixels have each shade of red, green and blue. Pixels not shown do not count."""
    shift, bits = 8 - BINS.bit_length() + 1, BINS.bit_length() - 1
    bins = []
    for f in frames:
        own = f.palette.astype(np.int64) >> shift
        bins.append(own[:, 0] << 2 * bits | own[:, 1] << bits | own[:, 2])
    # What is composed is each colour's bins at once; the last value stands for pixels not shown.
    for canvas in _composed(width, height, frames, bins, np.array(BINS**3)):
        cube = np.bincount(canvas.ravel(), minlength=BINS**3 + 1)[:-1].reshape(BINS, BINS, BINS)
        yield np.stack([cube.sum((1, 2)), cube.sum((0, 2)), cube.sum((0, 1))])


def filled(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, bytes([FILL]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_COLOURS = "red array<long>, green array<long>, blue array<long>"


def media(docs: DataFrame, content: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    n_frames, duration_ms, red, green, blue (histograms of BINS shades over all frames as shown).

    With content, the files too, as column media. All figures of the payload and
    the frames come from the stored file, decoded again. A null text counts as
    empty, which is one unit of fill bytes. Repeated rows give repeated rows, a null
    doc_id stays null, an empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    schema += "n_frames long, duration_ms long, " + _COLOURS + ", media binary" * content
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                file = store(filled(text.as_py() or ""))
                width, height, frames = load(file)
                back = b"".join(f.indices for f in frames)
                colours = sum(histograms(width, height, frames)).tolist()
                rows.append((len(back.rstrip(bytes([FILL]))), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), len(frames), sum(f.delay_ms for f in frames), *colours, *((file,) if content else ())))
            if rows:
                columns = [batch.column("doc_id"), *(pa.array(list(x)) for x in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return _texts(docs).mapInArrow(run, schema)


def timed_frames(media: DataFrame) -> DataFrame:
    """media: (doc_id, media), GIF files. A row for each frame: doc_id, frame, start_ms, delay_ms, place, disposal, transparent, red, green, blue, indices.

    left, top, width and height are the frame's place, indices its palette indices;
    the histograms are of the whole canvas as the frame shows it. A null file has
    no frames; a broken one is an error.
    """
    ship(media.sparkSession)
    schema = "doc_id long, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, transparent int, " + _COLOURS + ", indices binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, *[pa.list_(pa.int64())] * 3, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, file in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                if not file.is_valid:
                    continue
                width, height, frames = load(file.as_py())
                rows, start = [], 0
                for k, (f, colours) in enumerate(zip(frames, histograms(width, height, frames), strict=True)):
                    rows.append((doc, k, start, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, *colours.tolist(), f.indices))
                    start += f.delay_ms
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    read = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media"))
    return read.mapInArrow(run, schema)

"""GIF media columns: frames with times and colour histograms from GIF bytes, and lossless storage of bytes as GIF.

The decoder unpacks LZW code streams of any code size, applies global and local palettes, interlacing, transparency and
the four disposal rules, and gives the canvas after each frame. Code widths depend only on how many codes followed the
last clear code, so a whole run of codes is cut out of the bit stream at once.

Rows: null media give no frames; bytes that are no valid GIF raise BadGif (``frames`` can skip them instead); a null or
empty text is stored as one row of zeros. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, FRAME_ROWS, DELAY = 64, 256, 10


class BadGif(ValueError):
    """The bytes are no valid GIF."""


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the n codes after a clear code: a code is as wide as the next free table entry needs, 12 at most."""
    out = np.full(n, 12)
    for w in range(11, size, -1):
        out[: max(0, (1 << w) - (1 << size) - 1)] = w  # as long as the next free entry is below 2**w
    return out


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    clear = 1 << size
    codes, runs, table, free = [clear], [], {}, clear + 2
    if data:
        w = data[0]
        get = table.get
        for b in data[1:]:
            key = w << 8 | b
            c = get(key)
            if c is not None:
                w = c
                continue
            codes.append(w)
            w = b
            if free < 4096:
                table[key] = free
                free += 1
            else:
                codes.append(clear)
                runs.append(len(codes))
                table.clear()
                free = clear + 2
        codes.append(w)
    codes.append(clear + 1)
    at = [1, *runs, len(codes)]
    width = np.concatenate([[size + 1], *(_widths(b - a, size) for a, b in zip(at, at[1:], strict=False))])
    ends = np.cumsum(width)
    first = ends - width
    value = np.array(codes) << (first & 7)  # 12 bits and a shift of up to 7 lie in three bytes, and no two codes share a bit
    out = np.zeros(int(ends[-1] + 7) // 8 + 2)
    for i in range(3):
        out += np.bincount((first >> 3) + i, weights=(value >> (8 * i)) & 255, minlength=len(out))
    return out[:-2].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int) -> bytes:
    data = np.concatenate([np.frombuffer(stream, dtype=np.uint8), np.zeros(3, np.uint8)]).astype(np.int32)
    three = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    bits, clear, at, out = 8 * len(stream), 1 << size, 0, []
    while True:
        width = _widths(min((bits - at) // (size + 1), 4096 + (bits - at) // 12) + 1, size)
        ends = at + np.cumsum(width)
        width = width[: np.searchsorted(ends, bits, side="right")]
        if not len(width):
            raise BadGif("code stream without an end code")
        first = ends[: len(width)] - width
        codes = (three[first >> 3] >> (first & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stops):
            raise BadGif("code stream without an end code")
        stop = int(stops[0])
        _strings(codes[:stop].tolist(), clear, out)
        at = int(first[stop] + width[stop])
        if codes[stop] == clear + 1:
            return b"".join(out)


def _strings(codes: list[int], clear: int, out: list[bytes]) -> None:
    if not codes:
        return
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    if codes[0] >= clear:
        raise BadGif("first code")
    prev = table[codes[0]]
    out.append(prev)
    free = len(table)
    for c in codes[1:]:
        if c < free:
            s = table[c]
        elif c == free and free < 4096:
            s = prev + prev[:1]
        else:
            raise BadGif(f"code {c} of {free}")
        if free < 4096:
            table.append(prev + s[:1])
            free += 1
        out.append(s)
        prev = s


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    indexes: np.ndarray  # of the frame's own rectangle
    canvas: np.ndarray  # height x width x 4 (alpha 0: not drawn yet)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("cut off in a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise BadGif("cut off in a block")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF; raises BadGif, and nothing else, for bytes that are none or are cut off."""
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise BadGif("cut off") from e


def _part(data: bytes, at: int, n: int) -> np.ndarray:
    if at + 3 * n > len(data):
        raise BadGif("cut off in a palette")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")
    width, height, packed = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, None
    if packed & 0x80:
        n = 2 << (packed & 7)
        palette = _part(data, at, n)
        at += 3 * n
    canvas, clock = np.zeros((height, width, 4), np.uint8), 0
    delay, disposal, clear_index = 0, 0, None
    while True:
        kind = data[at : at + 1]
        if kind == b"\x3b":
            return
        if kind == b"\x21":
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = (body[0] >> 2) & 7, 10 * struct.unpack_from("<H", body, 1)[0]
                clear_index = body[3] if body[0] & 1 else None
            at = after
        elif kind == b"\x2c":
            x, y, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if packed & 0x80:
                n = 2 << (packed & 7)
                colours = _part(data, at, n)
                at += 3 * n
            if colours is None or not 1 <= data[at] <= 8 or x + w > width or y + h > height:
                raise BadGif("image without palette, code size or place")
            stream, after = _blocks(data, at + 1)
            pixels = lzw_decode(stream, data[at])
            at = after
            if len(pixels) < w * h:
                raise BadGif("too few pixels")
            indexes = np.frombuffer(pixels, np.uint8)[: w * h].reshape(h, w)
            if packed & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(indexes)
                plain[order] = indexes
                indexes = plain
            before = canvas.copy() if disposal == 3 else None
            drawn = indexes != clear_index if clear_index is not None else ...
            if len(colours) < 256 and indexes[drawn].max(initial=0) >= len(colours):
                raise BadGif("index beyond the palette")
            area = canvas[y : y + h, x : x + w]
            area[drawn] = np.concatenate([colours, np.full((len(colours), 1), 255, np.uint8)], axis=1)[indexes[drawn]]
            yield Frame(clock, delay, indexes, canvas)
            clock += delay
            if disposal == 2:
                canvas[y : y + h, x : x + w] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
        else:
            raise BadGif(f"block {kind!r}")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the drawn pixels in 8 x 8 x 8 colour bins."""
    packed = np.ascontiguousarray(canvas).view("<u4").ravel()
    packed = packed if packed.size == 0 or canvas[..., 3].min() else packed[packed >> 24 > 0]
    return np.bincount(((packed & 0xE0) << 1) | ((packed >> 10) & 0x38) | ((packed >> 21) & 7), minlength=512)


#: Index i is the grey level i, so a decoded canvas gives the stored bytes back.
GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes) -> bytes:
    """Rows of 64 samples as a timed sequence of full-width frames."""
    rows = len(payload) // WIDTH
    tall = min(rows, FRAME_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, tall, 0xF7, 0, 0), GREY]
    for a in range(0, rows, tall):
        part = payload[a * WIDTH : (a + tall) * WIDTH]
        stream = lzw_encode(part)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, DELAY, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        for i in range(0, len(stream), 255):
            chunk = stream[i : i + 255]
            out.append(bytes([len(chunk)]) + chunk)
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def payload_of(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return text + b"\x00" * (-len(text) % WIDTH or (WIDTH if not text else 0))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = batch.column("id"), [], 0
            first = 0
            for i, value in enumerate(batch.column("text")):
                text = (value.as_py() or "").encode()
                rows.append((len(text), encode(payload_of(text))))
                held += len(rows[-1][1])
                if held >= 4 << 20 or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "n_bytes", "media"])
                    first, rows, held = i + 1, [], 0

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def frames(media: DataFrame, skip_bad: bool = False) -> DataFrame:
    """(id, media) to one row per frame: (id, frame, start_ms, delay_ms, width, height, histogram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "frame", "start_ms", "delay_ms", "width", "height"]
        for batch in batches:
            for key, value in zip(batch.column("id"), batch.column("media"), strict=True):
                rows, bins = [], []
                try:
                    for i, f in enumerate(decode(value.as_py()) if value.is_valid else ()):
                        rows.append((key.as_py(), i, f.start_ms, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0]))
                        bins.append(histogram(f.canvas))
                except BadGif:
                    if not skip_bad:
                        raise
                if rows:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array([b.tolist() for b in bins], pa.list_(pa.int64()))], [*names, "histogram"])

    return media.select("id", "media").mapInArrow(run, "id long, frame long, start_ms long, delay_ms long, width long, height long, histogram array<long>")


def read_back(stored: DataFrame) -> DataFrame:
    """Decodes stored texts: their samples' checks, and frames, running time and colour histogram as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                media = value.as_py()
                parts, bins, ends, count = [], np.zeros(512, np.int64), 0, 0
                for f in decode(media):
                    area = f.canvas[: f.indexes.shape[0]]
                    parts.append(np.ascontiguousarray(area[..., 1]).tobytes())
                    bins += histogram(area)
                    ends, count = f.start_ms + f.delay_ms, count + 1
                payload = b"".join(parts)
                text = ",".join(f"{i}:{bins[i]}" for i in np.flatnonzero(bins))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={count};ms={ends};rgb8={text}"))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6(docs: DataFrame) -> DataFrame:
    return read_back(store(docs)).withColumnRenamed("id", "doc_id")

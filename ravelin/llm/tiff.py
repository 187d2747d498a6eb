"""TIFF: image directories, strips and tiles, PackBits, LZW and deflate, predictors; one row per page.

The reader takes classic TIFF in both byte orders, chunky samples of 8, 16 or 32 bits, compression 1 (none), 5 (LZW), 8 and 32946
(deflate) and 32773 (PackBits), and predictors 1 and 2; all else (BigTIFF, 1 or 4 bits, planes, predictor 3, other codecs) is an error. The writer
makes 8-bit grey pages of the same kinds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.words import freed, slices, small_batches

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: TIFF 6.0 field types: size in bytes and struct code (fixed values)
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
#: Tags (fixed values)
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
_CLEAR, _END = 256, 257


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader takes."""


def packbits_encode(raw: bytes) -> bytes:
    """Runs of 3 or more equal bytes as repeats, all else as literals of up to 128 bytes."""
    out, at, n = bytearray(), 0, len(raw)
    a = np.frombuffer(raw, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(edges) >= 3)

    def literals(stop: int) -> None:
        for i in range(at, stop, 128):
            part = raw[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for r in long.tolist():
        start, stop = int(edges[r]), int(edges[r + 1])
        literals(start)
        at = start
        while stop - at >= 2:
            k = min(128, stop - at)
            out.append(257 - k)
            out.append(raw[at])
            at += k
    literals(n)
    return bytes(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(raw)
    while at < n and len(out) < size:
        k = raw[at]
        if k < 128:
            out += raw[at + 1 : at + 2 + k]
            at += 2 + k
        elif k > 128:
            out += raw[at + 1 : at + 2] * (257 - k)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    """Most significant bit first; the code width grows one code early, as TIFF has it."""
    codes, widths = [_CLEAR], [9]
    table: dict[tuple[int, int], int] = {}
    width, following, current = 9, 258, -1
    for byte in raw:
        if current < 0:
            current = byte
            continue
        found = table.get((current, byte))
        if found is not None:
            current = found
            continue
        codes.append(current)
        widths.append(width)
        table[current, byte] = following
        following += 1
        current = byte
        if following == 4094:
            codes.append(_CLEAR)
            widths.append(12)
            table.clear()
            width, following = 9, 258
        elif following > (1 << width) - 1:
            width += 1
    if current >= 0:
        codes.append(current)
        widths.append(width)
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    codes.append(_END)
    widths.append(width)
    return _bits(np.array(codes, np.uint16), np.array(widths, np.int64))


def _bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = np.unpackbits(codes.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16)[None, :] >= 16 - widths[:, None]]).tobytes()


def lzw_decode(raw: bytes, size: int) -> bytes:
    out, made = [], 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, before = first.copy(), 9, b""
    hold = held = 0
    for byte in raw:
        hold = (hold << 8 | byte) & 0xFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = hold >> held & ((1 << width) - 1)
        if code == _CLEAR:
            table, width, before = first.copy(), 9, b""
            continue
        if code == _END:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise TiffError("LZW code out of range")
        if before:
            table.append(before + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        made += len(entry)
        if made >= size:
            break
        before = entry
    return b"".join(out)


def compress(raw: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: packbits_encode}[how](raw)


def decompress(raw: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        out = raw
    elif how == LZW:
        out = lzw_decode(raw, size)
    elif how in (DEFLATE, 32946):
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    elif how == PACKBITS:
        out = packbits_decode(raw, size)
    else:
        raise TiffError(f"compression {how} is not supported")
    if len(out) < size:
        raise TiffError("a strip or tile ends early")
    return out[:size]


def write_page(samples: np.ndarray, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: int = 0) -> bytes:
    """A TIFF of one 8-bit grey page, in strips or, with ``tile`` (a multiple of 16), in square tiles."""
    height, width = samples.shape
    blocks = []
    if tile:
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                block = np.zeros((tile, tile), np.uint8)
                part = samples[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [samples[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
    if predictor == 2:
        blocks = [np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1) for b in blocks]
    data = [compress(np.ascontiguousarray(b).tobytes(), compression) for b in blocks]
    offsets = (8 + np.cumsum([0, *(len(d) + len(d) % 2 for d in data)])).tolist()
    body = b"".join(d + b"\0" * (len(d) % 2) for d in data)
    fields: list[tuple[int, int, list[int]]] = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
    where, sizes = offsets[:-1], [len(d) for d in data]
    if tile:
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, where), (TILE_BYTES, 4, sizes)]
    else:
        fields += [(STRIP_OFFSETS, 4, where), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
    fields.sort()
    directory = offsets[-1]
    extra_at, entries, extra = directory + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values in fields:
        raw = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, directory) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


def join_pages(pages: list[bytes]) -> bytes:
    """One file of the pages of several little-endian files of :func:`write_page`."""
    out, last = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for page in pages:
        shift = len(out) - 8
        directory = struct.unpack_from("<I", page, 4)[0]
        body = bytearray(page)
        count = struct.unpack_from("<H", body, directory)[0]
        for i in range(count):
            at = directory + 2 + 12 * i
            tag, kind, n = struct.unpack_from("<HHI", body, at)
            far = TYPES[kind][0] * n > 4
            place = struct.unpack_from("<I", body, at + 8)[0] if far else at + 8
            if tag in (STRIP_OFFSETS, TILE_OFFSETS):
                struct.pack_into(f"<{n}I", body, place, *(x + shift for x in struct.unpack_from(f"<{n}I", body, place)))
            if far:
                struct.pack_into("<I", body, at + 8, place + shift)
        struct.pack_into("<I", out, last, directory + shift)
        out += body[8:]
        last = directory + shift + 2 + 12 * count
        if len(out) % 2:
            out += b"\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    bits: int
    channels: int
    compression: int
    predictor: int
    blocks: int
    samples: bytes


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and the fields of each directory. A chain that comes back to a directory it has passed is an error."""
    if len(raw) < 8 or raw[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if raw[:2] == b"II" else ">"
    if struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise TiffError("not classic TIFF")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        try:
            count, fields = struct.unpack_from(order + "H", raw, at)[0], {}
            for i in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
                if kind not in TYPES:
                    continue
                size, code = TYPES[kind]
                place = at + 10 + 12 * i
                if size * n > 4:
                    place = struct.unpack_from(order + "I", raw, place)[0]
                if place + size * n > len(raw):
                    raise TiffError("a field ends beyond the file")
                fields[tag] = struct.unpack_from(f"{order}{n}s" if code == "s" else order + code * n if len(code) > 1 else f"{order}{n}{code}", raw, place)
            at = struct.unpack_from(order + "I", raw, at + 2 + 12 * count)[0]
        except struct.error:
            raise TiffError("a directory ends beyond the file") from None
        yield order, fields


#: How many bytes a byte of each compression can stand for at most
_MOST = {NONE: 1, PACKBITS: 64, DEFLATE: 1040, 32946: 1040, LZW: 4096}


def pages(raw: bytes) -> Iterator[Page]:
    """Every page, with its samples decoded (row by row, in the machine's little-endian order). Whatever is wrong with the bytes is a :class:`TiffError`."""
    try:
        yield from _pages(raw)
    except (ArithmeticError, LookupError, TypeError, ValueError, struct.error, MemoryError) as e:
        raise e if isinstance(e, TiffError) else TiffError(f"broken fields: {type(e).__name__}: {e}") from None


def _pages(raw: bytes) -> Iterator[Page]:
    for number, (order, f) in enumerate(directories(raw)):
        one = lambda tag, default=None, f=f: f[tag][0] if tag in f else default
        width, height, channels, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PLANAR, 1)
        bits, how, predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if not all(isinstance(x, int) for x in (width, height, channels, planar, bits, how, predictor)) or min(width, height, channels) <= 0:
            raise TiffError("a page has no size")
        if len(set(f.get(BITS, (1,)))) != 1:
            raise TiffError("channels of different bits are not supported")
        if bits not in (8, 16, 32) or predictor not in (1, 2) or planar != 1 and channels > 1:
            raise TiffError(f"{bits} bits, predictor {predictor}, planar {planar} are not supported")
        dtype = np.dtype(f"{order}u{bits // 8}")
        tiled = TILE_OFFSETS in f
        where, sizes = (f[TILE_OFFSETS], f[TILE_BYTES]) if tiled else (f.get(STRIP_OFFSETS, ()), f.get(STRIP_BYTES, ()))
        w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
        if not isinstance(w, int) or not isinstance(h, int) or min(w, h) <= 0:
            raise TiffError("strips or tiles have no size")
        across = -(-width // w)
        if max(width * height, w * h) * channels * dtype.itemsize > _MOST.get(how, 4096) * len(raw):
            raise TiffError("a page is larger than its data can be")
        if len(where) != across * -(-height // h) or len(sizes) != len(where):
            raise TiffError("strips or tiles are missing")
        canvas = np.zeros((height, width, channels), dtype.newbyteorder("<"))
        for i, (at, size) in enumerate(zip(where, sizes, strict=True)):
            y, x = i // across * h, i % across * w
            rows = h if tiled else min(h, height - y)
            block = np.frombuffer(decompress(raw[at : at + size], how, rows * w * channels * dtype.itemsize), dtype).reshape(rows, w, channels)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
            canvas[y : y + rows, x : x + w] = block[: height - y, : width - x]
        yield Page(number, width, height, bits, channels, how, predictor, len(where), canvas.tobytes())


_PAGE = "page int, width int, height int, bits int, channels int, compression int, predictor int, blocks int, samples binary, error string"


def read_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of the TIFF in ``media``, after the columns of ``df``.

    A null or empty value and a file without pages give no row; a broken file gives the pages before the fault, then one row with null
    page columns and ``error``. Columns of ``df`` named like a page column are an error.
    """
    added = T._parse_datatype_string(_PAGE)
    if clash := set(added.names) & set(df.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(media))
            rows, found, size = [], [], 0

            def lot():
                arrays = [*(b.column(i).take(pa.array(rows, pa.int64())) for i in range(b.num_columns)), *(pa.array([x[i] for x in found], pa.int32()) for i in range(8)), pa.array([x[8] for x in found], pa.binary()), pa.array([x[9] for x in found], pa.string())]
                return pa.RecordBatch.from_arrays(arrays, names=schema.names)

            for i, raw in enumerate(column):
                raw = raw.as_py()
                if not raw:
                    continue
                try:
                    for p in pages(raw):
                        rows.append(i)
                        found.append((p.number, p.width, p.height, p.bits, p.channels, p.compression, p.predictor, p.blocks, p.samples, None))
                        size += len(p.samples)
                        if size > 4 << 20:
                            yield lot()
                            rows, found, size = [], [], 0
                except TiffError as e:
                    rows.append(i)
                    found.append((*[None] * 9, str(e)))
            yield lot()

    small_batches(df.sparkSession)
    return df.mapInArrow(freed(run), schema)


WIDTH_OF_TEXT = 64


def text_page(payload: bytes) -> bytes:
    """Store bytes (a positive multiple of 64) as a page 64 samples wide. The number of rows alone decides the form, so that equal payloads make equal files."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH_OF_TEXT)
    rows = len(samples)
    how = (DEFLATE, LZW, PACKBITS)[rows % 3]
    return write_page(samples, how, 2 if how == DEFLATE else 1, rows_per_strip=256, tile=WIDTH_OF_TEXT if rows > 128 else 0)


def store_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``n_bytes`` (UTF-8 length, null: 0) and ``media``: the text, padded with zero bytes, as a TIFF."""
    schema = T.StructType([*(df.schema[k] for k in keep)]).add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in slices(b.column(len(keep)), 4 << 20):
                media, sizes = [], np.diff(offsets)
                for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n = max(1, -(-(z - a) // WIDTH_OF_TEXT)) * WIDTH_OF_TEXT
                    media.append(text_page(data[a:z].tobytes().ljust(n, b"\0")))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(sizes)) for i in range(len(keep))), pa.array(sizes), pa.array(media, pa.binary())], names=schema.names)

    small_batches(df.sparkSession)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(freed(run), schema)

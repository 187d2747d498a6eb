"""Words of many byte strings at once: positions and 64-bit hashes by numpy, without a Python object for each word."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
#: Longer words are hashed one by one.
_LONG = 512


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for the largest ``n`` seen."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of a run of texts. ``start``, ``end``: in ``data``; ``doc``: the text each word is of; ``first``: each text's first word, and at last the number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
        self.data, self.offsets = data, offsets
        self._total = self._down = None
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = word[data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside & (~before | edge))
        self.end = np.flatnonzero(before & (~inside | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``length`` bytes of the words that have more, and the text each is of. They differ from the hashes of whole words."""
        at = np.flatnonzero(self.end - self.start > length)
        if not len(at):
            return np.zeros(0, np.uint64), self.doc[at]
        total, down = self._sums()
        start = self.start[at]
        return mix((total[start + length] - total[start]) * down[start] + np.uint64(length)), self.doc[at]

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self._total is None:
            up, self._down = powers(len(self.data))
            self._total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, out=self._total[1:])
        return self._total, self._down

    def hashes(self) -> np.ndarray:
        """Equal words have equal hashes; different ones almost always have different hashes, so callers that must be exact compare the bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total, down = self._sums()
        out = mix((total[self.end] - total[self.start]) * down[self.start])
        for i in np.flatnonzero(self.end - self.start > _LONG).tolist():  # where sums of powers could be made to collide
            out[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return out


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Batches that go to Python hold about ``most`` bytes, so that long texts do not fill an executor. A session that has a lower bound keeps it; how many rows a batch may have is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0) > most:
        spark.conf.set(key, str(most))


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a Python worker, which is kept for later tasks, gives back to the system what memory it no longer needs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return each


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts (strings or binary, read in place) of about ``most`` bytes (a longer text is a run of its own): the first row, the bytes, and the offsets in them. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to

"""Benchmark decontamination by winnowing.

Texts are cut into words; of each run of ``window - k + 1`` consecutive k-grams the one with the least hash is kept. Two texts
that share ``window`` consecutive words therefore share a kept k-gram, so every shared span of that length is found. Each
common fingerprint is a seed that is extended to the left and right, word by word and exactly; spans of at least ``window``
words count. An item of fewer than ``window`` words counts where it occurs whole, and is looked up by the hash of its whole length.

The test items' fingerprints go to the executors in parts of a checked size: as long as all items fit into one part
the documents are read once and never shuffled, and beyond that once for each part.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.words import ALNUM, LOWER, Words, freed, mix, slices, small_batches
from ravelin.scratch import materialize

_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words, by its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _GRAM
        out += hashes[i : i + n]
    return mix(out)


def winnow(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``w`` k-grams: the least hash and where it stands (the rightmost, if several are equal)."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.arange(n)
    for i in range(1, w):
        other = g[i : i + n]
        lower = other <= least
        least[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + i
    return least, at


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


_SPACED = bytes(LOWER[i] if ALNUM[LOWER[i]] else 32 for i in range(256))


class Index:
    """Fingerprints of test items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, k: int):
        self.window, self.k = window, k
        self.ids, self.words = [], []
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            w = split_words(text)
            if not w:
                continue
            i = len(self.ids)
            self.ids.append(item)
            self.words.append(w)
            h = self._hash(w)
            if len(w) < window:
                short[len(w)][int(grams(h, len(w))[0])].append(i)
            else:
                least, at = winnow(grams(h, k), window - k + 1)
                for value, place in sorted(set(zip(least.tolist(), at.tolist(), strict=True))):
                    seeds[value].append((i, place))
        self.seeds, self.short = dict(seeds), {n: dict(x) for n, x in short.items()}
        self.keys = {0: self._keys(self.seeds)} | {n: self._keys(x) for n, x in self.short.items()}

    @staticmethod
    def _hash(words: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b" ".join(words), np.uint8)
        return Words(data, np.array([0, len(data)]), ALNUM).hashes()

    @staticmethod
    def _keys(of: dict) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes, and flags by their low 16 bits."""
        keys = np.sort(np.fromiter(of, np.uint64, len(of)))
        flags = np.zeros(1 << 16, bool)
        flags[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        return keys, flags

    def known(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Where ``hashes`` are in the index for items of ``n`` words (0: seeds)."""
        keys, flags = self.keys[n]
        at = np.flatnonzero(flags[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        found = np.searchsorted(keys, hashes[at])
        return at[keys[np.minimum(found, len(keys) - 1)] == hashes[at]] if len(keys) else at[:0]

    def spans(self, words: list[bytes], seeds: list[tuple[int, int]], shorts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set]:
        """Extend the hits of one text. ``seeds``: (word, hash); ``shorts``: (word, length, hash). Spans are merged; the second result are item ids."""
        spans, items, done = [], set(), {}
        for p, value in seeds:
            for i, q in self.seeds[value]:
                if done.get((i, p - q), -1) > p:
                    continue
                item = self.words[i]
                a, b = p, q
                while a and b and words[a - 1] == item[b - 1]:
                    a, b = a - 1, b - 1
                c, d = p, q
                while c < len(words) and d < len(item) and words[c] == item[d]:
                    c, d = c + 1, d + 1
                done[i, p - q] = max(c, p + 1)
                if c - a >= self.window:
                    spans.append((a, c))
                    items.add(self.ids[i])
        for p, n, value in shorts:
            for i in self.short[n][value]:
                if words[p : p + n] == self.words[i]:
                    spans.append((p, p + n))
                    items.add(self.ids[i])
        return union(spans), items

    def search(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For each text: its number of words, its hit spans, and the items with occurring windows."""
        for _, data, offsets in slices(texts):
            w = Words(LOWER[data], offsets, ALNUM)
            h = w.hashes()
            seeds, shorts = defaultdict(list), defaultdict(list)
            if self.seeds:
                least, at = winnow(grams(h, self.k), self.window - self.k + 1)
                same = w.doc[: len(least)] == w.doc[self.window - 1 : self.window - 1 + len(least)]
                hits = self.known(0, least)
                hits = hits[same[hits]]
                _, once = np.unique(at[hits], return_index=True)
                for j in hits[once].tolist():
                    doc = int(w.doc[j])
                    seeds[doc].append((int(at[j] - w.first[doc]), int(least[j])))
            for n in self.short:
                g = grams(h, n)
                same = w.doc[: len(g)] == w.doc[n - 1 : n - 1 + len(g)]
                hits = self.known(n, g)
                for j in hits[same[hits]].tolist():
                    doc = int(w.doc[j])
                    shorts[doc].append((int(j - w.first[doc]), n, int(g[j])))
            counts = np.diff(w.first).tolist()
            for doc, count in enumerate(counts):
                if doc in seeds or doc in shorts:
                    words = split_words(data[offsets[doc] : offsets[doc + 1]].tobytes())
                    yield count, *self.spans(words, seeds[doc], shorts[doc])
                else:
                    yield count, [], set()


_HITS = "array<struct<start:bigint,stop:bigint>>"


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, part_bytes: int = 32 << 20) -> DataFrame:
    """Add ``n_words`` (bigint), ``hits`` (merged spans of word numbers, end exclusive) and ``items`` (sorted ids as strings) to ``docs``.

    A null text has no words; a null or empty item has no window and is found nowhere; items of a null id count as the id "".
    ``docs`` must not have columns of the three names. ``part_bytes`` bounds the item texts an executor holds at once.
    """
    if clash := {"n_words", "hits", "items"} & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    spark = docs.sparkSession
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("binary").alias("text")).where(F.length("text") > 0)
    total = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    if parts > 1:
        own = materialize(own.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts))), "items")
    out = docs
    for part in range(parts):
        rows = (own.where(F.col("part") == part) if parts > 1 else own).select("id", "text").collect()
        shared = spark.sparkContext.broadcast(pickle.dumps(Index([(r[0], bytes(r[1])) for r in rows], window, k)))
        out = _pass(out, text, shared, first=part == 0)
        if parts > 1:
            out = materialize(out, "decontam")
            shared.unpersist()
    return out


def _pass(docs: DataFrame, text: str, shared, first: bool) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "hits", "items")]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("hits", T._parse_datatype_string(_HITS)), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        index = pickle.loads(shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            counts, hits, items = [], [], []
            for n, spans, found in index.search(texts):
                counts.append(n)
                hits.append(spans)
                items.append(found)
            if not first:
                for i, (old, ids) in enumerate(zip(b.column(b.schema.get_field_index("hits")).to_pylist(), b.column(b.schema.get_field_index("items")).to_pylist(), strict=True)):
                    hits[i] = union([*hits[i], *((x["start"], x["stop"]) for x in old)])
                    items[i] |= set(ids)
            flat = np.array([x for spans in hits for x in spans], np.int64).reshape(-1, 2)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "stop"])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in hits])]).astype(np.int32))
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, structs), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(freed(run), schema)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]

"""Packing of tokenized documents into sequences by first-fit decreasing.

A document's ids are cut at multiples of the capacity, the pieces are dealt to groups by a hash, and each group is packed by itself; full pieces are sequences of their own, and the rest go, longest first, into the first sequence
with room, which a tournament tree over the sequences' free room finds in logarithmic time.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from ravelin.llm.words import LOWER, freed, slices, small_batches

_ENDINGS = b".,;:!?"
#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 signs, 4 what is not ASCII and the apostrophe
_KIND = np.full(256, 3, np.uint8)
_KIND[[*b" \t\n\r\f\v"]], _KIND[[*b"0123456789"]], _KIND[39], _KIND[128:] = 0, 2, 4, 4
_KIND[65:91] = _KIND[97:123] = 1
#: Letters and digits that no mark can be
_PLAIN = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: The pieces that white space cannot be part of or join: contractions, runs of letters, single digits, runs of all else but white space
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts cut where the tokenizer cuts them too, in lower case where that changes no ids: the number of each chunk, the distinct chunks, and each text's first chunk (at last how many there are).

    What stands between white space is one chunk if it has anything but ASCII or an apostrophe, or is of a text that may hold a special token; else runs of letters, digits, and runs of signs are.
    """
    n, kind = len(data), _KIND[data]
    texts = lambda at: np.unique(np.searchsorted(offsets, np.flatnonzero(at), "right") - 1)
    special = texts((data[:-1] == 60) & (data[1:] == 124))  # "<|", which is taken as it is written
    text = LOWER[data]
    for i in {*special.tolist(), *texts((data == 0xCC) | (data == 0xCD)).tolist()}:  # U+0300 to U+037F: ASCII letters compose with no other marks, which case might decide
        text[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    full = kind > 0
    first = full.copy()
    first[1:] &= ~full[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    odd = kind == 4
    for i in special.tolist():
        odd[offsets[i] : offsets[i + 1]] = True
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, np.flatnonzero(odd & full), "right") - 1] = True
    cut = first.copy()
    cut[1:] |= full[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    cut = np.flatnonzero(cut)
    cut = cut[first[cut] | ~whole[np.searchsorted(starts, cut, "right") - 1]]
    before = np.zeros(n + 1, np.int32)
    np.cumsum(full, out=before[1:])
    ends = np.append(before[cut], before[n])
    coded = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text[full])]).dictionary_encode()
    distinct = []
    if len(cut):
        _, at, raw = coded.dictionary.buffers()
        at, raw = np.frombuffer(at, np.int32, len(coded.dictionary) + 1).tolist(), raw.to_pybytes()
        distinct = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]  # to_pylist() is some times slower
    return coded.indices.to_numpy(), distinct, np.searchsorted(cut, offsets)


def drops_space(tokenizer_json: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space and never joins text across it, told by its normalizer and pre-tokenizer; anything that is not known to do so does not."""
    spec = json.loads(tokenizer_json)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [n.get("type") for n in norm.get("normalizers", [])]
    first, *rest = pre.get("pretokenizers") or [{}]
    cut = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": _PIECES}
    bytes_only = all(r.get("type") == "ByteLevel" and not r.get("add_prefix_space") and not r.get("use_regex") for r in rest)
    special = all(not t.get("normalized") and not t.get("lstrip") and not t.get("rstrip") and t["content"].startswith("<|") for t in spec.get("added_tokens") or [])
    return bool(cut and bytes_only and special and "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"} and not spec.get("truncation"))


class Encoder:
    """Token ids of whole texts, equal to ``tokenizer.encode(text, add_special_tokens=False)``.

    Where the tokenizer drops white space (:func:`drops_space`), white space and plain piece ends cut the text into chunks, each distinct chunk is encoded once, and its
    ids are reused; ``most`` bounds how many are kept, the latest ones, and as many that were used before them. Other tokenizers encode each text whole.
    """

    def __init__(self, tokenizer_json: str, most: int = 250_000):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.most, self.spaceless = most, drops_space(tokenizer_json)
        self.plain = self.tokenizer
        if self.spaceless:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = WhitespaceSplit()
        #: ids of chunks and of the parts they are made of, and of those that were used less of late
        self.kept: dict[bytes, bytes] = {}
        self.aged: dict[bytes, bytes] = {}
        self.apart: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")

    def _stands_apart(self, last: str) -> bool:
        """Whether the tokenizer takes punctuation after this character as a piece of its own; marks, signs and what is lower-cased to end in one run into it."""
        if last not in self.apart:
            text = last + "."
            if self.tokenizer.normalizer:
                text = self.tokenizer.normalizer.normalize_str(text)
            self.apart[last] = self.tokenizer.pre_tokenizer is not None and self.tokenizer.pre_tokenizer.pre_tokenize_str(text)[-1][0] == "."
        return self.apart[last]

    def _learn(self, plain: list[bytes], rest: list[bytes]) -> None:
        """Encode parts that were not seen, ``plain`` ones being a to z alone. Runs of letters are encoded in one call, split where words end; plain ones without the steps that change nothing in them."""
        letters, others = [], []
        for c in rest:
            (letters if c.decode().isalpha() else others).append(c)
        for some, tokenizer in ((plain, self.plain), (letters, self.tokenizer)):
            if not some:
                continue
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1 if self.closes.size and ids.size and ids.max() < self.closes.size else ids[:0]
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                self.kept.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                others += some
        for c, e in zip(others, self.tokenizer.encode_batch_fast([c.decode() for c in others], add_special_tokens=False), strict=True):
            self.kept[c] = np.array(e.ids, "<u4").tobytes()

    def _parts(self, c: bytes) -> list[bytes]:
        """What a chunk's ids are put together from. The case of ASCII chunks changes no ids (in others it may decide what a mark composes with), nor does taking closing punctuation off after a letter or digit."""
        if b"<|" in c:  # it might be a special token, which is taken as it is written
            return [c]
        if c.isascii():
            c = c.lower()
            if c.isalpha():
                return [c]
        core = c.rstrip(_ENDINGS)
        if len(core) < len(c) and core and (core[-1] in _PLAIN or core[-1] >= 128 and self._stands_apart(core.decode()[-1])):
            return [core, c[len(core) :]]
        return [c]  # the tokenizer takes a run of marks and signs as one piece

    def learn(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of ``chunks``, which are distinct."""
        chunks = list(chunks)
        return dict(zip(chunks, self._ids(chunks), strict=True))

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.kept) > self.most:
            self.aged, self.kept = self.kept, {}
        kept, aged = self.kept, self.aged
        out = list(map(kept.get, chunks))
        unknown = [i for i, x in enumerate(out) if x is None]
        missing = []
        for i in unknown:
            c = chunks[i]
            if c in aged:
                kept[c] = aged[c]
            else:
                missing.append(c)
        plain = {c for c in missing if c.isalpha() and c.islower()}
        waiting, rest = [], set()
        for c in (c for c in missing if c not in plain):
            parts = self._parts(c)
            waiting.append((c, parts))
            for p in parts:
                if p in aged:
                    kept[p] = aged[p]
                elif p not in kept:
                    (plain if p.isalpha() and p.islower() else rest).add(p)
        self._learn(list(plain), list(rest))
        for c, parts in waiting:
            kept[c] = kept[parts[0]] if len(parts) == 1 else b"".join([kept[p] for p in parts])
        for i in unknown:
            out[i] = kept[chunks[i]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.spaceless:
            raw, cuts = data.tobytes(), offsets.tolist()
            for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()
            return
        number, distinct, first = _chunks(data, offsets)
        ids = self._ids(distinct)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(count) - count
        times = count[number]
        ends = np.append(0, np.cumsum(times))
        out = flat[np.repeat(start[number] - ends[:-1], times) + np.arange(ends[-1])].tobytes()
        ends = (4 * ends[first]).tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield out[a:b]


class Tournament:
    """First sequence, from the left, with enough room. Each inner node holds the most room below it."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.size)
        self.used = 0

    def place(self, need: int) -> int:
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < need:
                i += 1
        room[i] -= need
        leaf = i - self.size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        self.used = max(self.used, leaf + 1)
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (1 to ``capacity``); ties in size keep their order."""
    if not sizes:
        return []
    tree, out = Tournament(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out


def pack(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset there of each piece; pieces of the whole capacity get bins of their own, after the others."""
    part = [i for i, n in enumerate(sizes) if n < capacity]
    bins, offsets, filled = [0] * len(sizes), [0] * len(sizes), {}
    for i, b in zip(part, first_fit_decreasing([sizes[i] for i in part], capacity), strict=True):
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = offsets[i] + sizes[i]
    for b, i in enumerate((i for i, n in enumerate(sizes) if n == capacity), len(filled)):
        bins[i] = b
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int | None = 1, ids: bool = True) -> DataFrame:
    """Each text's token ids, cut at multiples of ``capacity``: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids_crc32``, ``copy`` and, with ``ids``, the ``ids``.

    ``copy`` tells equal pieces of a partition apart: null for the first of them, then numbers that are of this partition.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = _encoder(shared.value), Counter(), TaskContext.get()
        partition = (task.partitionId() if task else 0) << 32
        for b in batches:
            keys = b.column(0).to_pylist()
            for at, data, offsets in slices(b.column(1), 4 << 20):
                rows, start, length, total, crc, raw, copy = [], [], [], [], [], [], []
                for i, body in enumerate(encoder.encode(data, offsets), at):
                    body += tail
                    for a in range(0, len(body), step):
                        piece = body[a : a + step]
                        rows.append(i)
                        start.append(a // 4)
                        length.append(len(piece) // 4)
                        total.append(len(body) // 4)
                        crc.append(zlib.crc32(piece))
                        known = (keys[i], a, crc[-1])
                        copy.append(partition + seen[known] if seen[known] else None)
                        seen[known] += 1
                        raw.append(np.frombuffer(piece, "<u4"))
                out = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc, copy))]
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "copy"]
                if ids:
                    flat = np.concatenate(raw).astype(np.int32) if raw else np.zeros(0, np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    columns = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, copy bigint" + ", ids array<int>" * ids
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(freed(run), columns)


_encoders: dict[str, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    """A Python worker keeps the encoder it used last, with the chunks that it knows."""
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = Encoder(tokenizer_json)
    return _encoders[tokenizer_json]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int | None = 1, group_docs: int = 2048, ids: bool = True, seed: int = 0) -> DataFrame:
    """The pieces of :func:`token_pieces` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    Each text (null: empty) is encoded whole and closed by ``end_id``; with no end id, an empty text has no piece. Rows of one id
    are documents of their own. The pieces of about ``group_docs`` rows by a salted hash are packed each group by itself, so that a task's memory
    follows the group and a lost task is repeated with the same result; the pieces of a very long document and repeated rows are dealt to many groups. Only what the
    pieces carry is shuffled: with ``ids`` their ids too. The tokenizer file is read on the driver and sent to the executors (a vocabulary of a few MB).
    An empty table has no pieces; other columns of ``docs`` are not read.
    """
    groups = max(1, -(-docs.count() // group_docs))
    pieces = token_pieces(docs, tokenizer_path, id_col, text, capacity, end_id, ids)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "copy"), F.lit(groups))).drop("copy")
    schema = dealt.drop("_group").schema.add("sequence_id", "long").add("offset", "long")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack(table.column("length").to_pylist(), capacity)
        group = table.column("_group")[0].as_py() << 32
        out = table.drop_columns(["_group"])
        return out.append_column("sequence_id", pa.array([group + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("_group").applyInArrow(run, schema)

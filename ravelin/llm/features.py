"""Bounded labelled samples, and features of many texts at once for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.words import ALNUM, LOWER, NOT_SPACE, Words, byte_class, freed, slices, small_batches
from ravelin.scratch import materialize


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus`` (a null id: of the empty string)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def lowest(ids: DataFrame, order: Column, most: int) -> DataFrame:
    """The ``most`` distinct rows with the lowest hashes.

    Where there are many more rows, those with hashes far above the share that is wanted are left aside first, so that each partition sends few rows to be
    ordered; should too few distinct rows be below that (as when rows repeat), all are ordered after all.
    """
    n = ids.count()
    if n > 4 * most:
        few = ids.where(order < int((2 * most / n - 0.5) * 2**64)).distinct()
        if few.count() >= most:
            return few.orderBy(order, *ids.columns).limit(most)
    return ids.distinct().orderBy(order, *ids.columns).limit(most)


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, id_col: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """A table of at most ``most`` rows ``id``, ``text``, ``columns``: of the documents that have a label (a row of ``labels``), those whose ids hash lowest, so that every id is as likely and the same come each time.

    An id counts once: with the greatest label of each column, and of several texts the one whose hash is least. Only ids are ordered; the chosen
    labels, at most ``most`` rows, are broadcast to the scan of the documents. Whole texts go to the shared folder, none to the driver.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    chosen = lowest(labels.where(F.col(id_col).isNotNull()).select(id_col), order, most)
    if columns:
        chosen = labels.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(*[F.max(c).alias(c) for c in columns])
    rows = docs.select(id_col, F.col(text).alias("_text")).join(F.broadcast(chosen), id_col).withColumn("_hash", F.xxhash64("_text"))
    return materialize(rows.groupBy(F.col(id_col).alias("id"), *columns).agg(F.min_by("_text", "_hash").alias("text")), "sample")


def matrix(rows: DataFrame, of: Callable[[pa.Array], np.ndarray], columns: list[str]) -> tuple[np.ndarray, list]:
    """Features (32-bit floats, a row for each text) that executors compute of a bounded sample's texts, and the sample's other columns, by id."""
    kept = ["id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = of(b.column(len(kept))).astype("<f4")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([r.tobytes() for r in x], pa.binary())], names=[*kept, "x"])

    small_batches(rows.sparkSession)
    schema = T.StructType([rows.schema[c] for c in kept]).add("x", "binary")
    found = sorted(rows.select(*kept, "text").mapInArrow(freed(run), schema).collect(), key=lambda r: r[0])
    width = of(pa.array([], pa.string())).shape[1]
    return np.frombuffer(b"".join(r[-1] for r in found), "<f4").reshape(len(found), width), [tuple(r)[:-1] for r in found]


def binary(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.large_binary())


#: Beginnings of words that count as features besides whole words, in bytes
PREFIXES = (4, 5, 6, 7, 8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts and of how they begin, and the text each is of."""
    w = Words(LOWER[data], offsets, ALNUM)
    parts = [(w.hashes(), w.doc), *(w.prefixes(n) for n in PREFIXES)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Vocabulary:
    """Chosen tokens by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(np.asarray(hashes, np.uint64))
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How often each token occurs in each text."""
        out = np.zeros((len(texts), len(self)), np.float32)
        for at, data, offsets in slices(texts) if len(self) else ():
            h, doc = tokens(data, offsets)
            maybe = np.flatnonzero(self.flags[(h & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self) - 1)
            hit = self.hashes[place] == h[maybe]
            np.add.at(out, (at + doc[maybe[hit]], place[hit]), 1)
        return out


def token_counts(rows: DataFrame, label: str, folds: int, least: int = 3) -> DataFrame:
    """``token`` (hash) of those in at least ``least`` texts of a sample, and in how many it is, by fold and label: ``n`` (array, the label's two counts for each fold). A row's fold is a hash of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(0).to_numpy()
            for at, data, offsets in slices(b.column(1)):
                h, doc = tokens(data, offsets)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                token, which = np.unique(h[new], return_inverse=True)
                n = np.bincount(which * 2 * folds + cell[at + doc[new]], minlength=len(token) * 2 * folds).astype(np.int64)
                ends = pa.array((np.arange(len(token) + 1) * 2 * folds).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(n))], names=["token", "n"])

    small_batches(rows.sparkSession)
    cell = (fold_of("id", folds) * 2 + (F.col(label) > 0).cast("int")).cast("int")
    counted = rows.select(cell.alias("cell"), "text").mapInArrow(freed(run), "token bigint, n array<bigint>")
    sums = counted.groupBy("token").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(2 * folds)])
    return sums.where(" + ".join(f"n{i}" for i in range(2 * folds)) + f" >= {least}").select("token", F.array(*[f"n{i}" for i in range(2 * folds)]).alias("n"))


def fold_of(id_col: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(folds)).cast("int")


def standing_out(n1: Column, n0: Column, t1: int, t0: int) -> Column:
    """How far a token's share among ``t1`` texts of label 1 stands out from that among ``t0`` others: the signed root of the likelihood-ratio statistic."""
    t1, t0 = max(1, t1), max(1, t0)
    has, total = n1 + n0, t1 + t0
    part = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)
    test = 2 * (part(n1, t1, has) + part(t1 - n1, t1, total - has) + part(n0, t0, has) + part(t0 - n0, t0, total - has))
    return F.signum(n1 / t1 - n0 / t0) * F.sqrt(F.greatest(test, F.lit(0.0)))


_CLASSES = {
    "upper": byte_class((65, 90)),
    "lower": byte_class((97, 122)),
    "digit": byte_class((48, 57)),
    "high": byte_class((128, 255)),
    "space": byte_class((32, 32), (9, 13)),
    "stop": byte_class((33, 33), (44, 44), (46, 46), (63, 63)),
    "bar": byte_class((124, 124)),
    "mark": byte_class((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 123), (125, 126)),
    "bang": byte_class((33, 33)),
    "line": byte_class((10, 10)),
}
STYLE = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "word_spread", "distinct", "repeated", "long_words", "log_line", "end_stop", "long_lines", "short_lines", "repeated_lines"]


def style(texts: pa.Array) -> np.ndarray:
    """Shares and sizes that describe how a text is written, whatever its words mean; all finite, zeros for an empty text."""
    out = np.zeros((len(texts), len(STYLE)), np.float32)
    for at, data, offsets in slices(texts):
        n = np.diff(offsets)
        rows, some = slice(at, at + len(n)), np.maximum(n, 1)
        col = 0
        sums = {}
        for name, table in _CLASSES.items():
            total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            sums[name] = total[offsets[1:]] - total[offsets[:-1]]
            out[rows, col] = sums[name] / some
            col += 1
        w = Words(data, offsets, NOT_SPACE)
        words = np.diff(w.first)
        many = np.maximum(words, 1)
        size = (w.end - w.start).astype(np.float64)
        mean = np.bincount(w.doc, size, len(n)) / many
        spread = np.sqrt(np.maximum(0, np.bincount(w.doc, size**2, len(n)) / many - mean**2))
        h = w.hashes()
        same = np.zeros(len(h))
        if len(h) > 1:
            same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        order = np.lexsort((h, w.doc))
        hs, ds = h[order], w.doc[order]
        first = np.ones(len(h))
        if len(h) > 1:
            first[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        lines = Words(data, offsets, _NOT_NEWLINE)
        length = (lines.end - lines.start).astype(np.float64)
        count = np.maximum(np.diff(lines.first), 1)
        lh = lines.hashes()
        order = np.lexsort((lh, lines.doc))
        ls, ld = lh[order], lines.doc[order]
        twice = np.zeros(len(lh))
        if len(lh) > 1:
            twice[1:] = (ls[1:] == ls[:-1]) & (ld[1:] == ld[:-1])
        last = np.zeros(len(n))
        has = words > 0
        last[has] = _CLASSES["stop"][data[w.end[w.first[1:][has] - 1] - 1]]
        values = [np.log1p(n) / 10, np.log1p(words) / 10, np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, np.bincount(ds, first, len(n)) / many, np.bincount(w.doc, same, len(n)) / many, np.bincount(w.doc, size > 16, len(n)) / many, np.log1p(n / (1 + sums["line"])) / 10, last, np.bincount(lines.doc, length > 400, len(n)) / count, np.bincount(lines.doc, length < 30, len(n)) / count, np.bincount(ld, twice, len(n)) / count]
        for v in values:
            out[rows, col] = v
            col += 1
    return out


_NOT_NEWLINE = ~byte_class((10, 10))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression by Newton's steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])

"""SimHash near-duplicates: exact Hamming comparison in tiles with numpy exclusive-or and bit counts.

Two 64-bit fingerprints that differ in at most ``radius`` bits agree in full on at least ``blocks - radius`` of ``blocks``
bit blocks. Each distinct fingerprint is therefore filed once for each choice of ``blocks - radius`` blocks, and only fingerprints
filed under one key are compared, so no pair is missed and work follows the input rather than its square. Under one key the
comparison is tiled: fingerprints are sorted by population count, and a pair of tiles whose counts differ by more than the
radius is skipped. A key with more fingerprints than a tile holds is dealt to several tasks by population count, where pairs of
counts beyond the radius are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.components import connected_components
from ravelin.llm.words import LOWER, NOT_SPACE, Words, freed, slices, small_batches
from ravelin.scratch import materialize

SEED, SHINGLE, RADIUS, BLOCKS, TILE = 42, 3, 2, 5, 1024


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; none give zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by single spaces. ``data`` holds lower-cased bytes; fewer words than ``size``: of all of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw, h, n = data.tobytes(), xxhash.xxh64_intdigest, max(1, len(starts) - size + 1)
    last = ends[min(size, len(starts)) - 1 :]
    if np.all(data[ends[:-1]] == 32) and np.all(starts[1:] - ends[:-1] == 1):  # as if joined already
        return np.array([h(raw[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.array([h(b" ".join(words[i : i + size]), SEED) for i in range(n)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` (as bigint) and ``fingerprint`` (bigint) of each row. Null and empty texts have fingerprint zero; A-Z are lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, data, offsets in slices(b.column(1)):
                low = LOWER[data]
                w = Words(low, offsets, NOT_SPACE)
                for a, z, at in zip(w.first[:-1].tolist(), w.first[1:].tolist(), offsets[:-1].tolist(), strict=True):
                    if a == z:
                        out.append(0)
                        continue
                    end = int(w.end[z - 1])
                    out.append(fingerprint(shingle_hashes(low[at:end], w.start[a:z] - at, w.end[a:z] - at)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(freed(run), "id bigint, fingerprint bigint")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The masks of the block choices, as signed 64-bit numbers."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:], strict=False)]
    masks = [sum(parts[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """Union-find over small arrays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def tiled_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius`` between two arrays of fingerprints (or inside one, if ``right`` is None)."""
    both = left if right is None else np.concatenate([left, right])
    forest, out = Forest(len(both)), []

    def order(a: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = np.bitwise_count(a)
        o = np.argsort(bits, kind="stable")
        return a[o], bits[o].astype(np.int64), o + shift

    a, ab, ai = order(left, 0)
    b, bb, bi = (a, ab, ai) if right is None else order(right, len(left))
    for i in range(0, len(a), tile):
        for j in range(i if right is None else 0, len(b), tile):
            x, y = slice(i, i + tile), slice(j, j + tile)
            if bb[y][0] - ab[x][-1] > radius:
                break
            if ab[x][0] - bb[y][-1] > radius:
                continue
            near = np.bitwise_count(a[x, None] ^ b[None, y]) <= radius
            if right is None and i == j:
                near = np.triu(near, 1)
            for p, q in np.argwhere(near).tolist():
                u, v = int(ai[i + p]), int(bi[j + q])
                if forest.join(u, v):
                    out.append((int(both[u]), int(both[v])))
    return out


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links ``u``, ``v`` (bigint) that connect all distinct ``fingerprint`` values within ``radius`` bits; repeated values must be removed before.

    The links span what all pairs would connect; pairs are not listed in full.
    """
    filed = distinct.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks(radius, blocks))])).alias("key")).select("fingerprint", "key.*")
    sizes = filed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = filed.join(sizes, ["choice", "bits"])
    count = F.bit_count("fingerprint")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(4 * tile))).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), parts).cast("int")
    others = F.sequence(F.lit(0), parts - 1)
    #: cells of a large key: the lower population count, the difference, and the part on either side
    def cells_of(gap: int, side: int, among: Column) -> Column:
        low = count if side == 0 else count - gap
        return F.transform(among, lambda o: F.struct(low.alias("low"), F.lit(gap).alias("gap"), (own if side == 0 else o).alias("x"), (o if side == 0 else own).alias("y"), F.lit(side).alias("side")))

    apart = [cells_of(gap, side, others) for gap in range(1, radius + 1) for side in (0, 1)]
    cells = F.flatten(F.array(*apart, cells_of(0, 0, F.filter(others, lambda o: o >= own)), cells_of(0, 1, F.filter(others, lambda o: o < own))))
    one = F.array(F.struct(F.lit(-1).alias("low"), F.lit(0).alias("gap"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    key = ["choice", "bits", "cell.low", "cell.gap", "cell.x", "cell.y"]
    dealt = met.withColumn("cell", F.explode(F.when(F.col("n") <= 2 * tile, one).otherwise(cells))).select("fingerprint", F.col("cell.side").alias("side"), F.xxhash64(*key).alias("group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, kept = None, []

        def links(fp: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
            if len(fp) < 2:
                return []
            fp = fp.view(np.uint64)
            return tiled_links(fp, None, radius, tile) if not side.any() else tiled_links(fp[side == 0], fp[side == 1], radius, tile)

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])

        for b in batches:
            g, fp, side = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.flatnonzero(g[1:] != g[:-1]) + 1
            out = []
            for a, z in zip([0, *ends.tolist()], [*ends.tolist(), len(g)], strict=True):
                if a == z:
                    continue
                if open_group is not None and g[a] != open_group:
                    out += links(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                    kept = []
                open_group = g[a]
                kept.append((fp[a:z], side[a:z]))
            yield made(out)
        if kept:
            yield made(links(*(np.concatenate(x) for x in zip(*kept, strict=True))))

    placed = dealt.repartition("group").sortWithinPartitions("group", "side", "fingerprint")
    return placed.select("group", "fingerprint", "side").mapInArrow(freed(run), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id``, ``fingerprint`` (bigint) and ``component_id`` of each row of ``docs``.

    ``component_id`` is the least id that can be reached over links of at most ``radius`` differing bits, the row's own
    included. Rows with null ids take part and get the least id of their component (null if it has none). An empty table gives
    no rows; other columns of ``docs`` are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text), "fingerprints")
    return components_of(marked, radius)


def components_of(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The same for a table of ``id`` and ``fingerprint`` that can be read several times."""
    least = materialize(marked.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(near_links(least.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    joined = least.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    component = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(joined.select("fingerprint", "root").join(component, "root").select("fingerprint", "component_id"), "fingerprint").select("id", "fingerprint", "component_id")

"""SimHash near-duplicates at a given Jaccard similarity of word-shingle sets: the same tiled comparison, at a wide radius, before an exact check.

Sets of a similarity of 0.8 have SimHash fingerprints that differ in some 10 of 64 bits (12 where the sets are tiny), so links are looked for within
:data:`RADIUS` bits, which loses one in 100,000 at worst. No choice of bit blocks files such pairs together; banded minima do so in
place of the blocks: a band is a hash of ``ROWS`` minima, and two sets meet if one of ``BANDS`` bands is equal, which a pair of similarity s
misses with probability (1 - s**5)**36, 6e-7 at 0.8 and less above. Whatever meets is compared by fingerprint and then on the whole sets, so no
pair below the least similarity is linked. Equal sets are one node from the start.

In a band, each node is first held against the band's least one. Only bands that this leaves with several components are then compared in
full, each once however many bands hold the same nodes, in cells of bounded size whose tasks return spanning links alone: many copies of one text do
not make all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.components import connected_components
from ravelin.llm.simhash import fingerprint, shingle_hashes
from ravelin.llm.words import LOWER, NOT_SPACE, Words, freed, mix, slices, small_batches
from ravelin.scratch import materialize, remove

SHINGLE, BANDS, ROWS, RADIUS, TILE = 5, 36, 5, 26, 1024
#: The least similarity, in tenths.
TENTHS = 8
#: Shingles of one side of a cell (2 MB of hashes), where each set counts as 256 more, so that a side has at most 1024 sets.
CELL = 1 << 18
#: A table of nodes goes to every executor up to so many rows (16 bytes each), and is shuffled beyond.
SENT = 2_000_000

_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` hashes for each run of ``hashes`` that begins at ``starts`` (no run is empty)."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for i, factor in enumerate(_FACTORS):
        k = i // ROWS
        out[:, k] = mix((out[:, k] * np.uint64(0x9E3779B97F4A7C15)) ^ np.minimum.reduceat(mix(hashes * factor), starts) ^ np.uint64(k + 1))
    return out


def _sets(texts: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of runs of texts."""
    for _, data, offsets in slices(texts):
        low = LOWER[data]
        w = Words(low, offsets, NOT_SPACE)
        found = []
        for a, z, at in zip(w.first[:-1].tolist(), w.first[1:].tolist(), offsets[:-1].tolist(), strict=True):
            found.append(np.unique(shingle_hashes(low[at : int(w.end[z - 1])], w.start[a:z] - at, w.end[a:z] - at, size)) if a < z else np.zeros(0, np.uint64))
        yield found


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def shingle_sets(docs: DataFrame, id_col: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``id``, ``text_hash``, ``node`` (a hash of the shingle set), ``n`` (its size), ``fingerprint`` and ``bands`` of each row. Null and empty texts have the empty set, which has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for sets in _sets(b.column(2), size):
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
                n = np.array([len(s) for s in sets], np.int64)
                ends = np.cumsum(n)
                some = n > 0
                made = bands(np.concatenate(sets), (ends - n)[some]).ravel() if some.any() else np.zeros(0, np.uint64)
                prints = np.array([fingerprint(s) for s in sets], np.uint64)
                kept = [b.column(i).slice(row, len(sets)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(node.view(np.int64)), pa.array(n), pa.array(prints.view(np.int64)), _lists(made, some * BANDS)], names=["id", "text_hash", "node", "n", "fingerprint", "bands"])
                row += len(sets)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(freed(run), "id bigint, text_hash bigint, node bigint, n bigint, fingerprint bigint, bands array<bigint>")


def sets_of(docs: DataFrame, chosen: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``node`` and ``hashes`` (the sorted set) of the texts whose ``text_hash`` is in ``chosen`` (``text_hash``, ``node``), each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for sets in _sets(b.column(1), size):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(sets)), _lists(np.concatenate(sets), np.array([len(s) for s in sets]))], names=["node", "hashes"])
                row += len(sets)

    small_batches(docs.sparkSession)
    found = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(bounded(chosen), "text_hash").select("node", "text")
    return found.mapInArrow(freed(run), "node bigint, hashes array<bigint>").groupBy("node").agg(F.first("hashes").alias("hashes"))


def bounded(few: DataFrame, most: int = SENT) -> DataFrame:
    """``few`` for the executors' memory if it is small enough, else as it is."""
    return F.broadcast(few) if few.count() <= most else few


def confirmed(pairs: DataFrame, sets: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """Of the pairs ``u``, ``v``, those whose ``hashes`` have a Jaccard similarity of at least ``tenths`` tenths."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}"))
    both = F.size(F.array_intersect("_u", "_v"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where((10 + tenths) * both >= tenths * (F.size("_u") + F.size("_v"))).select("u", "v")


def near_tiles(prints: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints that differ in at most ``radius`` bits, one of ``left`` and one of ``right`` (None: both of ``left``): tiles by population count, those beyond the radius skipped."""
    bits = np.bitwise_count(prints).astype(np.int64)
    a, b = (x[np.argsort(bits[x], kind="stable")] for x in (left, left if right is None else right))
    for i in range(0, len(a), tile):
        for j in range(i if right is None else 0, len(b), tile):
            x, y = a[i : i + tile], b[j : j + tile]
            if bits[y[0]] - bits[x[-1]] > radius:
                break
            if bits[x[0]] - bits[y[-1]] > radius:
                continue
            near = np.bitwise_count(prints[x, None] ^ prints[None, y]) <= radius
            p, q = np.nonzero(np.triu(near, 1) if right is None and i == j else near)
            yield x[p], y[q]


def spanning_links(sets: list[np.ndarray], prints: np.ndarray, root: np.ndarray, side: np.ndarray, tenths: int = TENTHS, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """Links that span all pairs of sets, one of either ``side`` (all of them, if there is one side only), within ``radius`` bits and of the similarity; those of one ``root`` are joined already.

    A tile's pairs are counted on the sets by an index from shingles to sets, a row of the tile at a time and only where a pair is still apart.
    """
    n = np.array([len(s) for s in sets], np.int64)
    _, group = np.unique(root, return_inverse=True)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(codes, kind="stable")
    holders, counts = owner[order], np.bincount(codes)
    stop = np.cumsum(counts)
    start = stop - counts
    begin = np.cumsum(n) - n
    out = []
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(sets)), None)
    for p, q in near_tiles(prints, left, right, radius, tile):
        ok = (group[p] != group[q]) & (10 * n[p] >= tenths * n[q]) & (10 * n[q] >= tenths * n[p])
        p, q = p[ok], q[ok]
        by = np.argsort(p, kind="stable")
        p, q = p[by], q[by]
        cuts = np.flatnonzero(np.diff(p)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
            if a == z:
                continue
            i, others = int(p[a]), q[a:z]
            others = others[group[others] != group[i]]
            if not len(others):
                continue
            mine = codes[begin[i] : begin[i] + n[i]]
            both = np.bincount(np.concatenate([holders[start[c] : stop[c]] for c in mine.tolist()]), minlength=len(sets))[others]
            for j in others[(10 + tenths) * both >= tenths * (n[i] + n[others])].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    out.append((i, j))
    return out


def cross_links(members: DataFrame, sets: DataFrame, tenths: int = TENTHS, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links ``u``, ``v`` that span those between nodes of one ``band`` in different components (``members``: ``band``, ``node``, ``n``, ``fingerprint``, ``root``).

    Bands of the same nodes are one. A band of more than ``cell`` shingles (and 256 for each set) is cut into parts by a hash of the node, and each pair of parts is a cell of its own.
    """
    of = members.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.sum(F.col("n") + 256).alias("w"), F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.sum(F.xxhash64(F.lit(1), "node") % (1 << 40))).alias("who"))
    mixed = of.where("a <> z").groupBy("who").agg(F.min("band").alias("band"), F.first("w").alias("w")).select("band", "w")
    parts = F.ceil(F.col("w") / F.lit(cell)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), (own > o).cast("int").alias("side")))
    dealt = members.join(mixed, "band").withColumn("cell", F.explode(cells)).select(F.xxhash64("band", "cell.x", "cell.y").alias("cell"), F.col("cell.side").alias("side"), "node", "fingerprint", "root")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        hashes = table.column("hashes").chunk(0)
        ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(np.uint64)
        prints, root, side = (table.column(c).to_numpy() for c in ("fingerprint", "root", "side"))
        node = table.column("node").to_numpy()
        found = spanning_links([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], prints.view(np.uint64), root, side, tenths, radius)
        x = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(node[x[:, 0]]), pa.array(node[x[:, 1]])], names=["u", "v"])

    return dealt.join(sets, "node").groupBy("cell").applyInArrow(run, "u bigint, v bigint")


def near_copies(docs: DataFrame, id_col: str, text: str = "text", size: int = SHINGLE, tenths: int = TENTHS, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """``id``, ``text_hash`` and ``component`` of each row: rows of one component are joined by links of at least ``tenths`` tenths similarity.

    A null text is like an empty one; rows without words are all alike. Repeated rows, null ids and an empty table are as good as others: the result has
    a row for each row. Other columns of ``docs`` are not read. ``docs`` is read twice, so it should be a table.
    """
    marked = materialize(shingle_sets(docs, id_col, text, size), "shingles")
    nodes = marked.groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"), F.min("text_hash").alias("text_hash"))
    filed = nodes.select("node", "n", "fingerprint", "text_hash", F.posexplode("bands").alias("at", "value")).select("node", "n", "fingerprint", "text_hash", F.xxhash64("at", "value").alias("band"))
    sizes = filed.groupBy("band").agg(F.min(F.struct("node", "fingerprint")).alias("least"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    met = materialize(filed.join(sizes, "band"), "bands")
    sets = materialize(sets_of(docs, met.groupBy("node").agg(F.first("text_hash").alias("text_hash")), text, size), "sets")
    stars = met.where((F.col("node") != F.col("least.node")) & (F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("least.fingerprint"))) <= radius))
    first = materialize(confirmed(stars.select(F.col("least.node").alias("u"), F.col("node").alias("v")).distinct(), sets, tenths), "links")
    members = met.join(connected_components(first), "node", "left").select("band", "node", "n", "fingerprint", F.coalesce("root", "node").alias("root"))
    second = materialize(cross_links(members, sets, tenths, radius, cell), "links")
    for done in (met, sets):
        remove(done)
    roots = connected_components(first.unionByName(second)).withColumnRenamed("root", "component")
    return marked.select("id", "text_hash", "node").join(roots, "node", "left").select("id", "text_hash", F.coalesce("component", "node").alias("component"))

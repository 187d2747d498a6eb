"""Weighted rendezvous hashing of stable record keys.

Each key draws one hash for each shard and goes to the shard with the highest score ``-weight / ln(u)``. A shard's score
depends on no other shard, so that one shard more takes rows only into itself and one less gives up only its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 to ``len(weights) - 1``) of a key. A null key is hashed like the empty string. Ties go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{shard}"), text), 11)
        return F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53)))

    scores = F.array(*[score(i, w) for i, w in enumerate(weights)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def with_slots(df: DataFrame, shard: str, key: str, order: Sequence[str] = (), rows_per_task: int = 200_000) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps in each shard.

    Rows are numbered within (shard, cell of the hash of key and ``order``), and each cell starts where the cells before it end, so that no
    task sees a whole shard and a key that a third of all rows have is spread over many cells by ``order``. Rows equal in both are numbered by one task, a row at a
    time. A column ``slot`` of ``df`` is an error; all others are kept.
    """
    _check(df, "slot")
    cell, start, at, n = (_unused(df, c) for c in ("_cell", "_start", "_at", "_n"))
    cells = max(1, -(-df.count() // rows_per_task)) * 16
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(F.lit("cell"), *[F.col(c) for c in (key, *order)]), F.lit(cells)))
    before = Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(shard, cell).agg(F.count(F.lit(1)).alias(n)).withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    within = Window.partitionBy(shard, cell).orderBy(*[F.col(c) for c in (key, *order)])
    numbered = dealt.withColumn(at, F.row_number().over(within) - 1)
    return numbered.join(starts, [shard, cell]).select(*df.columns, (F.col(start) + F.col(at)).cast("long").alias("slot"))


def _check(df: DataFrame, *added: str) -> None:
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def shard_records(df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = (), seed: int = 0, grown_weight: float | None = None) -> DataFrame:
    """Add ``shard`` and ``slot``, and with ``grown_weight`` also ``grown_shard``: the shard once one more of that weight exists.

    A null key counts as the empty string, and rows of one key always share a shard. Columns of ``df`` named like an added one are an error; all others are kept as
    they are. An empty table stays empty.
    """
    _check(df, "shard", "slot", *(["grown_shard"] if grown_weight is not None else []))
    out = df.withColumn("shard", rendezvous(F.col(key), weights, seed))
    if grown_weight is not None:
        out = out.withColumn("grown_shard", rendezvous(F.col(key), [*weights, grown_weight], seed))
    return with_slots(out, "shard", key, order)

"""Greedy matching of scored pairs, by rounds that decide every pair whose fate is settled.

The rule is sequential: pairs by falling score, each first id takes at most ``cap`` targets, each target is taken once, and with a ``gap`` a first id that holds two takes no
pair further below its best score. A pair's fate hangs only on better pairs that share an end with it. In a round, a pair is taken if it is its target's best open pair
and among the best of its first id as long as all pairs before it there are taken in the same round too: a first id thus takes a whole run of its list at once. Ties go by first id,
then candidate id. Chains that outlast the rounds are finished by the sequential rule itself, each connected component of open pairs apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.components import connected_components
from ravelin.scratch import materialize, remove

CAP, GAP, SINGLETON = 8, 0.16, 0.40
_KEYS = ["country", "s1_id", "cand_id", "score"]


def above_threshold(scored: DataFrame, thresholds: dict[str, float], default: float) -> DataFrame:
    """Pairs whose score reaches their country's threshold (another country: ``default``)."""
    tau = F.lit(default)
    for country, value in thresholds.items():
        tau = F.when(F.col("country") == country, F.lit(value)).otherwise(tau)
    return scored.where(F.col("score") >= tau)


def _best(df: DataFrame, key: str) -> DataFrame:
    """Flag each key's best row; the aggregate combines before the shuffle, so that a key of very many rows does no harm."""
    first = F.struct((-F.col("score")).alias("score"), F.col("s1_id"), F.col("cand_id"))
    return df.groupBy("country", key).agg(F.min(first).alias("first")).select("country", key, F.col("first.s1_id").alias("b1"), F.col("first.cand_id").alias("b2"))


def _settled(open_: DataFrame, cap: int, gap: float | None) -> DataFrame:
    """The open pairs that can be taken now.

    A first id's list is cut before its first pair that is not its target's best, found by an aggregate, so that no task orders a whole list; what is before the cut are at
    most as many rows as the id has targets that want it most.
    """
    order = F.struct((-F.col("score")).alias("score"), F.col("cand_id"))
    theirs = _best(open_, "cand_id").select("country", "cand_id", F.col("b1").alias("wanted"))
    marked = open_.join(theirs, ["country", "cand_id"]).withColumn("mine", F.col("wanted") == F.col("s1_id"))
    stop = marked.groupBy("country", "s1_id").agg(F.min(F.when(~F.col("mine"), order)).alias("stop"))
    run = marked.where("mine").join(stop, ["country", "s1_id"]).where(F.col("stop").isNull() | (order < F.col("stop")))
    mine = Window.partitionBy("country", "s1_id").orderBy(F.desc("score"), "cand_id")
    run = run.withColumn("nth", F.row_number().over(mine) + F.col("held")).where(F.col("nth") <= cap)
    if gap is not None:
        run = run.where((F.col("nth") <= 2) | (F.col("score") >= F.col("top") - gap))
    return run.select(*_KEYS)


def sequential(rows: list[tuple], cap: int, gap: float | None) -> list[int]:
    """The rule itself on (s1_id, cand_id, score, top, held) of one component: the places of the pairs that are taken."""
    held, taken, out = {}, set(), []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][2], rows[i][0], rows[i][1])):
        s, c, score, top, before = rows[i]
        n = held.setdefault(s, before)
        if c in taken or n >= cap or gap is not None and n >= 2 and score < top - gap:
            continue
        held[s] = n + 1
        taken.add(c)
        out.append(i)
    return out


def _finish(open_: DataFrame, cap: int, gap: float | None) -> DataFrame:
    """Each connected component of open pairs by :func:`sequential`; a component's pairs are one task's work."""
    a, b = F.xxhash64(F.lit("s"), "country", "s1_id"), F.xxhash64(F.lit("c"), "country", "cand_id")
    roots = connected_components(open_.select(a.alias("u"), b.alias("v")))
    grouped = open_.withColumn("node", a).join(roots, "node").select(*_KEYS, "top", "held", "root")
    names = ("s1_id", "cand_id", "score", "top", "held")

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in names), strict=True))
        return table.select(_KEYS).take(pa.array(sequential(rows, cap, gap), pa.int64()))

    return grouped.groupBy("root").applyInArrow(run, open_.select(*_KEYS).schema)


def greedy_match(pairs: DataFrame, cap: int = CAP, gap: float | None = GAP, singleton: float | None = None, rounds: int = 12) -> DataFrame:
    """The matched pairs of ``country, s1_id, cand_id, score``; countries are matched apart.

    ``singleton``: a first id whose best score is below it gets nothing. Repeated pairs count once, with their best score; pairs with a null are left out; no pairs give none.
    Each round is written to the shared folder. After ``rounds`` rounds what is left open is finished by components (:func:`_finish`), so that there is no number of rounds that a
    chain of ties could exceed.
    """
    clean = pairs.select(*_KEYS).dropna().groupBy("country", "s1_id", "cand_id").agg(F.max("score").alias("score"))
    top = clean.groupBy("country", "s1_id").agg(F.max("score").alias("top"))
    if singleton is not None:
        top = top.where(F.col("top") >= singleton)
    open_ = materialize(clean.join(top, ["country", "s1_id"]).withColumn("held", F.lit(0)), "open")
    out = clean.limit(0)
    for last in range(1, rounds + 1):
        if open_.isEmpty():
            return out
        taken = materialize(_settled(open_, cap, gap), "taken")
        out = out.unionByName(taken)
        rest = open_.join(taken.select("country", "cand_id"), ["country", "cand_id"], "left_anti")
        more = taken.groupBy("country", "s1_id").agg(F.count(F.lit(1)).cast("int").alias("more"))
        rest = rest.join(more, ["country", "s1_id"], "left").withColumn("held", F.col("held") + F.coalesce("more", F.lit(0))).drop("more").where(F.col("held") < cap)
        if gap is not None:
            rest = rest.where((F.col("held") < 2) | (F.col("score") >= F.col("top") - gap))
        after = materialize(rest.select(*_KEYS, "top", "held"), "open")
        remove(open_)
        open_ = after
    return out if open_.isEmpty() else out.unionByName(materialize(_finish(open_, cap, gap), "taken"))


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of both their ends."""
    s = Window.partitionBy("country", "s1_id").orderBy(F.desc("score"), "s1_id", "cand_id")
    c = Window.partitionBy("country", "cand_id").orderBy(F.desc("score"), "s1_id", "cand_id")
    return pairs.select(*_KEYS).withColumn("i", F.row_number().over(s)).withColumn("j", F.row_number().over(c)).where("i = 1 and j = 1").drop("i", "j")

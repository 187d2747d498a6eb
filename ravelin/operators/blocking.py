"""Candidate pairs: all channels as one join on (country, channel, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.keys import CAPS, WEIGHTS, key_table
from ravelin.operators.tfidf import tfidf_pairs as tfidf_pairs
from ravelin.scratch import materialize

MAX_CANDIDATES = 180


def _by_channel(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


#: A table of keys over their caps goes to every executor up to so many rows (some 60 bytes each), and is joined beyond
SENT = 500_000


def capped(targets: DataFrame, channels: list[str] | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """The key table of ``targets`` without keys that more rows have than their channel's cap, each record once a key.

    Rows are counted by key with partial sums. The keys over their caps are written down and counted; while they are few they go to the executors, so that their rows are
    left out where they are made: a key that a third of all records share never meets in one task.
    """
    key = ["country", "channel", "key"]
    sums = key_table(targets, channels).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    over = materialize(sums.where(F.col("n") > F.try_element_at(_by_channel(caps or CAPS), F.col("channel"))).select(*key), "over")
    return key_table(targets, channels, once=True).join(F.broadcast(over) if over.count() <= SENT else over, key, "left_anti")


def hits(s1: DataFrame, targets: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """``country, channel, s1_id, cand_id`` for every key that both sides share; the same pair may come once for each key. A key that very many first records have is split by Spark's skew join."""
    left = key_table(s1, channels, once=True).withColumnRenamed("entity_id", "s1_id")
    right = capped(targets, channels).withColumnRenamed("entity_id", "cand_id")
    return left.join(right, ["country", "channel", "key"]).select("country", "channel", "s1_id", "cand_id")


def channel_counts(found: DataFrame) -> DataFrame:
    """One row a pair: the number of different one-hit channels, or the highest weight of the others if that is more."""
    weight = F.try_element_at(_by_channel(WEIGHTS), F.col("channel"))
    bit = F.try_element_at(_by_channel({c: 1 << i for i, c in enumerate(CAPS)}), F.col("channel")).cast("bigint")
    both = found.groupBy("country", "s1_id", "cand_id").agg(F.coalesce(F.bit_count(F.bit_or(F.when(weight.isNull(), bit))), F.lit(0)).alias("singles"), F.max(weight).alias("weight"))
    return both.select("country", "s1_id", "cand_id", F.greatest("singles", F.coalesce("weight", F.lit(0))).cast("bigint").alias("channel_count"))


def top_candidates(counted: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """The ``most`` pairs of each first id with the highest counts; ties go by candidate id."""
    order = Window.partitionBy("country", "s1_id").orderBy(F.desc("channel_count"), "cand_id")
    return counted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def candidates(s1: DataFrame, targets: DataFrame, channels: list[str] | None = None, most: int = MAX_CANDIDATES) -> DataFrame:
    """Candidates of normalized records: ``country, s1_id, cand_id, channel_count``."""
    return top_candidates(channel_counts(hits(s1, targets, channels)), most)


def recall(pool: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """How many true links are in the pool: by country, and in all (country null)."""
    found = truth.join(pool.select("s1_id", "cand_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "cand_id"], "left").join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return found.rollup("country").agg(F.count(F.lit(1)).alias("n_links"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))

"""Connected components by alternating large-star and small-star steps (no link is collected to the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.scratch import materialize, remove


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of ``links`` (bigint ``u``, ``v``) with ``root``, the least node that each can reach.

    Self-links and repeated links are ignored; a link with a null end is ignored; no links give no rows. Each round writes its
    links to the shared folder, so that neither the lineage nor a lost executor's data grows with the rounds. A node with very
    many neighbours is only ever aggregated to its minimum, or is the skewed side of a join with one row per node.
    """
    links = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    before = None
    for _ in range(max_rounds):
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _minima(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        remove(links)
        links = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontam, packing, pii, resemblance, toxicity
from ravelin.llm.queries import TOXIC
from ravelin.scratch import materialize


def _apart(docs: DataFrame, *read: str) -> DataFrame:
    """``docs`` with the columns that a stage does not read under names that no operator uses, so that extra columns may be named like an operator's."""
    return docs.select(*read, *[F.col(f"`{c}`").alias(f"_column_{i}") for i, c in enumerate(docs.columns) if c not in read])


def _back(found: DataFrame, docs: DataFrame, *read: str) -> DataFrame:
    """The columns of ``docs`` again, from a table that was made of :func:`_apart`."""
    return found.select(*[F.col(c) if c in read else F.col(f"_column_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents whose toxicity reaches the threshold. A null text is scored as an empty one."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(toxicity.score(_apart(docs, "text"), chain).where(F.col("p_toxic") < TOXIC), docs, "text")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies (5-word similarity of 0.8 or more): the one with the least doc_id, and of those that repeat it, one.

    A row without an id goes by a hash of its text, which is above any usual id. Rows of one id with different texts are judged each by its own text. What is
    joined to the documents are the rows that have near copies: sent to the executors if they are few enough, else shuffled.
    """
    of_text = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    keyed = _apart(docs, "doc_id", "text").withColumn("_key", F.coalesce("doc_id", of_text)).withColumn("_hash", F.xxhash64("text"))
    found = materialize(resemblance.near_copies(keyed, "_key"), "components")
    rows = found.groupBy("component", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    crowded = rows.groupBy("component").agg(F.sum("n").alias("all"), F.min(F.struct("id", "text_hash")).alias("kept")).where("all > 1")
    kept = F.struct("id", "text_hash") == F.col("kept")
    judged = rows.join(crowded, "component").select(F.col("id").alias("_key"), F.col("text_hash").alias("_hash"), F.when(kept, F.col("n")).otherwise(0).alias("_n"))
    joined = keyed.join(resemblance.bounded(materialize(judged, "judged")), ["_key", "_hash"], "left")
    once, more = joined.where("_n is null or _n = 1"), joined.where("_n > 1").dropDuplicates(["_key", "_hash"])
    return _back(once.unionByName(more), docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents in which a window of a benchmark item occurs."""
    found = decontam.find_contamination(_apart(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(found.where(F.size("hits") == 0), docs, "text")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put each span's kind in its place, and count the characters anew. Null texts stay null."""
    found = pii.find_personal_data(_apart(docs, "text", "n_chars"), redacted="clean")
    text = F.when(F.col("text").isNotNull(), F.col("clean"))
    return _back(found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")), docs, "text", "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: XXH64, learned classifiers and tokenizers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

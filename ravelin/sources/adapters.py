"""Records of three sources made of the test tables: whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _split_sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("entity_id").startswith("S1-")), df.where(~F.col("entity_id").startswith("S1-"))


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores (one small file) is dealt to all of them; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document: the first six words are the name and all others the address."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").when(F.col("lang") == "es", "India").otherwise(F.col("lang"))
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")).select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.array_join(F.slice(w, 1, 6), " ").alias("business_name"),
        F.array_join(F.slice(w, 7, F.greatest(F.size(w), F.lit(1))), " ").alias("business_address"),
        F.coalesce(country, F.lit("")).alias("country"),
    )


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short record for each part: its name and type with a legal suffix, and a made-up address of its size and brand."""
    size = F.col("p_size")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    brand = F.replace("p_brand", F.lit("#"), F.lit(" "))
    town = pick(size, "Springfield", "Mumbai", "Lyon", "Austin", "Bangalore")
    state = pick(size, "TX", "MH", "Rhone", "TX", "Karnataka")
    address = F.concat(size.cast("string"), F.lit(" "), brand, F.lit(" St, Near "), F.lower("p_type"), F.lit(" depot, "), town, F.lit(", "), state, F.lit(" "), (size * 137 + 410000).cast("string"))
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(
        F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-"), key).alias("entity_id"),
        F.concat("p_name", F.lit(" "), F.lower("p_type"), pick(F.col("p_partkey"), " Ltd", " Inc.", "", " Enterprises")).alias("business_name"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit("N/A")).otherwise(address).alias("business_address"),
        pick(size, "US", "India", "France", "US", "India").alias("country"),
    )


def part_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between parts of one name, size and brand in different sources."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", "p_size", "p_brand", F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"))
    a, b = p.where("id like 'S1-%'").withColumnRenamed("id", "s1_id"), p.where("id not like 'S1-%'").withColumnRenamed("id", "cand_id")
    return a.join(b, ["p_name", "p_size", "p_brand"]).select("s1_id", "cand_id")

"""Readers and writers of record-linkage files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ravelin.functions.normalize import normalize
from ravelin.schema import RECORD, TRUTH


def read_tsv(spark: SparkSession, path: str, schema: StructType = RECORD) -> DataFrame:
    """A tab-separated file with a header and no quoting; ragged rows are cut or filled with nulls. Columns go by name; missing ones are null."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="", mode="PERMISSIVE", inferSchema=False)
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH)


def write_lists(pairs: DataFrame, s1: DataFrame, path: str, column: str = "matched_entity_ids") -> None:
    """One row for each record of ``s1``: its sorted partner ids, comma-joined, empty if it has none."""
    export_lists(pairs, s1, column).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def export_lists(pairs: DataFrame, s1: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("cand_id")), ",").alias(column))
    return s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def export_candidates(pool: DataFrame, matches: DataFrame, s1: DataFrame) -> DataFrame:
    """Candidates and matches together, in the same shape."""
    both = pool.select("s1_id", "cand_id").unionByName(matches.select("s1_id", "cand_id")).distinct()
    return export_lists(both, s1, "candidate_entity_ids")


def _state(spark: SparkSession, path: str) -> str | None:
    """Names, sizes and times of the files of ``path``, as a hash; None if there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f for found in fs.globStatus(place) or [] for f in (fs.listStatus(found.getPath()) if found.isDirectory() else [found])]
    told = sorted(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(told).encode()).hexdigest() if told else None


def load_source(spark: SparkSession, tsv: str, cache: str | None = None, version: str = "1") -> DataFrame:
    """Normalized records of a file. With ``cache``, they are kept there by country, under a name made of the path and ``version``, and read from there
    until the file's size or time is another. Of a file that is gone, what was kept is read."""
    if cache is None:
        return normalize(read_tsv(spark, tsv))
    place = f"{cache.rstrip('/')}/{hashlib.sha256(f'{tsv}\n{version}'.encode()).hexdigest()[:16]}"
    made_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place + "/_made_of")
    fs = made_of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept, state = None, _state(spark, tsv)
    if fs.exists(made_of):
        told = fs.open(made_of)
        kept = told.readUTF()
        told.close()
    if kept is None or state not in (None, kept):
        normalize(read_tsv(spark, tsv)).withColumn("country_part", F.col("country")).write.mode("overwrite").partitionBy("country_part").parquet(place)
        told = fs.create(made_of, True)
        told.writeUTF(state or "")
        told.close()
    return spark.read.parquet(place).drop("country_part")


def load_split(spark: SparkSession, folder: str, train: bool, cache: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The three sources of a folder, and in training the truth's links."""
    from ravelin.operators.metrics import parse_truth

    kind = "train" if train else "test"
    sources = [load_source(spark, f"{folder}/{kind}_source{i}.tsv", cache) for i in (1, 2, 3)]
    return (*sources, parse_truth(read_truth(spark, f"{folder}/train_ground_truth.tsv")) if train else None)

"""The registered query of each operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontam, langid, packing, pii, quality, sharding, simhash, tiff, toxicity, warc
from ravelin.llm.features import remainder
from ravelin.scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tiff.read_pages(tiff.store_texts(_table(spark, sf_dir, "documents")))
    size, feature = F.length("samples").cast("long"), F.format_string("%dx%d/c%d/p%d/b%d", "width", "height", "compression", "predictor", "blocks")
    return read.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, length(samples) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: From this probability on, a document is toxic.
TOXIC = 0.5


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the probability of each category of the chain, and whether the last reaches :data:`TOXIC`."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.drop("text").withColumn("toxic", F.col("p_toxic") >= TOXIC)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = new_path(spark, "warc")
    warc.archive_pages(_table(spark, sf_dir, "pages"), path)
    read = lambda payload: spark.read.format(warc.FORMAT).option("payload", payload).load(path)
    page = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) as bigint)")
    full = read("true").where(F.col("record_type") == "response").select("record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    again = read("false").where(F.col("record_type") == "revisit").select("record_id", "record_type", "refers_to", F.col("http_length").alias("payload_bytes"), "payload_digest")
    both = full.unionByName(again)
    return both.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.shard_records(rows, "doc_id", [1.0] * 8, order=["size", "text_crc32"], grown_weight=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    network = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _is(kind: str) -> Callable:
    return lambda s: s["kind"] == kind


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    added = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in pii.ADDED]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), *added)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": """
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
m as (select payload_digest, payload_bytes, max(page_id) kept from p where payload_bytes >= 1000 group by all)
select page_id, payload_bytes::bigint payload_bytes, payload_digest,
       case when kept <> page_id then 'revisit' else 'response' end record_type, case when kept <> page_id then kept end refers_to
from p left join m using (payload_digest, payload_bytes)""",
        "op8_decontamination": f"""
with d as (select doc_id, {_WORDS_SQL} w from documents),
b as (select item_id, {_WORDS_SQL} w from benchmark),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') win
       from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') win
       from d, (select distinct n from bw) s, unnest(range(1, len(w) - n + 2)) t(i)),
m as (select doc_id, n, i, item_id from dw join bw using (n, win)),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from m) group by doc_id),
x as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
      from (select distinct doc_id, item_id::varchar item from m) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join x using (doc_id)""",
    }

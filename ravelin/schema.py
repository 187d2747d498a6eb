"""Schemas of the record-linkage tables."""

from pyspark.sql.types import LongType, StringType, StructField, StructType


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


#: One source table. The id's prefix (S1-, S2-, S3-) tells the source.
RECORD = _strings("entity_id", "business_name", "business_address", "country")
#: The truth as delivered: a comma-separated list in a string
TRUTH = _strings("source1_entity_id", "matched_entity_ids")
LINK = _strings("s1_id", "cand_id")
CANDIDATE = _strings("country", "s1_id", "cand_id").add("channel_count", LongType())

"""The 56 features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import similarity as S
from ravelin.functions.normalize import words

SCORED = 30
HARD_NEGATIVES = 5
GENERIC_NAME = 50

# Feature names, in the order of the matrix
FEATURES = [
    "name_jw", "name_lev", "name_jaccard", "name_overlap", "name_token_sort_ratio", "name_token_set_ratio", "name_lcs_ratio", "name_first_tok", "name_last_tok", "name_contains", "name_prefix_len", "name_char_3gram_jaccard",
    "translit_jw", "translit_lev", "translit_jaccard", "translit_overlap", "translit_first_tok", "translit_char_3gram_jaccard",
    "addr_jw", "addr_lev", "addr_jaccard", "addr_overlap", "addr_token_sort_ratio", "addr_token_set_ratio", "addr_len_ratio", "addr_has_both", "addr_missing_cand", "addr_char_4gram_jaccard",
    "postal_match", "postal_prefix_match", "street_num_match", "city_sim", "city_exact_match", "postal_log_freq", "city_log_freq", "has_postal_both",
    "name_len_ratio", "name_char_diff", "name_token_diff", "name_log_freq_s1", "name_log_freq_cand", "name_is_generic",
    "name_addr_prod", "name_addr_sum", "name_postal_prod", "name_jw_x_addr_missing", "max_name_sim", "min_name_sim", "name_sim_range", "addr_sim_harmonic",
    "source_is_s2", "source_is_s3", "num_candidates", "tfidf_score", "tfidf_rank", "blocking_channel_count",
]


def frequencies(s1: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """How many records of a country, of all sources, have a name, a postal code and a city; the empty postal code and city are not counted."""
    both = s1.select("country", "name_norm", "postal_code", "city").unionByName(targets.select("country", "name_norm", "postal_code", "city"))
    count = lambda c: (both if c == "name_norm" else both.where(F.col(c) != "")).groupBy("country", c).agg(F.count(F.lit(1)).alias("freq"))
    return {c: count(c) for c in ("name_norm", "postal_code", "city")}


def top_pairs(pool: DataFrame, most: int = SCORED) -> DataFrame:
    """Add ``num_candidates`` (of the whole pool) and keep the ``most`` best candidates of each record."""
    mine = Window.partitionBy("country", "s1_id")
    order = mine.orderBy(F.desc("channel_count"), "cand_id")
    ranked = pool.withColumn("num_candidates", F.count(F.lit(1)).over(mine)).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def training_pairs(pool: DataFrame, truth: DataFrame, negatives: int = HARD_NEGATIVES) -> DataFrame:
    """Every positive pair of the pool, and each record's ``negatives`` best-ranked others; with ``label`` and ``num_candidates``."""
    labelled = with_label(pool.withColumn("num_candidates", F.count(F.lit(1)).over(Window.partitionBy("country", "s1_id"))), truth)
    order = Window.partitionBy("country", "s1_id", "label").orderBy(F.desc("channel_count"), "cand_id")
    return labelled.withColumn("_rank", F.row_number().over(order)).where((F.col("label") == 1) | (F.col("_rank") <= negatives)).drop("_rank")


def with_label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``label``: 1 for true links, else 0."""
    links = truth.select("s1_id", "cand_id", F.lit(1).alias("label")).distinct()
    return pairs.join(links, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


_SIDE = ("name_norm", "name_blocking", "addr_norm", "postal_code", "postal_prefix_3", "city", "street_number")


def _sided(df: DataFrame, key: str, side: str) -> DataFrame:
    return df.select("country", F.col("entity_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in _SIDE])


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _matched(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), -1.0).otherwise(_flag(a == b))


def joined_pairs(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with both records' columns (``a_`` and ``b_``) and their frequencies; pairs of unknown ids go."""
    out = pairs.join(_sided(s1, "s1_id", "a"), ["country", "s1_id"]).join(_sided(targets, "cand_id", "b"), ["country", "cand_id"])
    of = frequencies(s1, targets)
    for side, column, name, default in (("a", "name_norm", "name_freq_a", 1), ("b", "name_norm", "name_freq_b", 1), ("a", "postal_code", "postal_freq", 0), ("a", "city", "city_freq", 0)):
        renamed = of[column].select("country", F.col(column).alias(f"{side}_{column}"), F.col("freq").alias(name))
        out = out.join(renamed, ["country", f"{side}_{column}"], "left").withColumn(name, F.coalesce(name, F.lit(default)))
    return out


def features(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """``country, s1_id, cand_id``, ``label`` if ``pairs`` has it, and the columns of :data:`FEATURES`.

    ``pairs`` needs ``channel_count`` and ``num_candidates``. A feature of two missing or one missing texts is 0; the three that compare codes are -1 then.
    """
    df = joined_pairs(pairs, s1, targets)
    an, bn, ab, bb, aa, ba = (F.col(c) for c in ("a_name_norm", "b_name_norm", "a_name_blocking", "b_name_blocking", "a_addr_norm", "b_addr_norm"))
    udfs = {
        "name_jw": S.jaro_winkler(an, bn), "translit_jw": S.jaro_winkler(ab, bb), "addr_jw": S.jaro_winkler(aa, ba), "city_sim": S.jaro_winkler("a_city", "b_city"),
        "name_token_sort_ratio": S.token_sort_ratio(an, bn), "addr_token_sort_ratio": S.token_sort_ratio(aa, ba),
        "name_token_set_ratio": S.token_set_ratio(an, bn), "addr_token_set_ratio": S.token_set_ratio(aa, ba), "name_lcs_ratio": S.lcs_ratio(an, bn),
    }
    df = df.withColumns(udfs).withColumns(native_features())
    kept = ["country", "s1_id", "cand_id", *(["label"] if "label" in pairs.columns else [])]
    return df.withColumns(combined_features()).select(*kept, *FEATURES)


def native_features() -> dict[str, Column]:
    """The features that are expressions of :func:`joined_pairs` alone."""
    an, bn, ab, bb, aa, ba = (F.col(c) for c in ("a_name_norm", "b_name_norm", "a_name_blocking", "b_name_blocking", "a_addr_norm", "b_addr_norm"))
    first, last = (lambda x: F.get(words(x), F.lit(0))), (lambda x: F.get(words(x), F.size(words(x)) - 1))
    named, addressed = (an != "") & (bn != ""), (aa != "") & (ba != "")
    length = lambda x: F.length(x)
    ratio = lambda x, y: F.least(length(x), length(y)) / F.greatest(length(x), length(y), F.lit(1))
    postal_both = (F.col("a_postal_code") != "") & (F.col("b_postal_code") != "")
    return {
        "name_lev": S.levenshtein_similarity(an, bn),
        "name_jaccard": S.token_jaccard(an, bn),
        "name_overlap": S.token_overlap(an, bn),
        "name_first_tok": _flag(first(an) == first(bn)),
        "name_last_tok": _flag(last(an) == last(bn)),
        "name_contains": _flag(named & (F.contains(an, bn) | F.contains(bn, an))),
        "name_prefix_len": F.when(named, S.common_prefix(an, bn) / F.greatest(length(an), length(bn), F.lit(1))).otherwise(0.0),
        "name_char_3gram_jaccard": S.gram_jaccard(an, bn, 3),
        "translit_lev": S.levenshtein_similarity(ab, bb),
        "translit_jaccard": S.token_jaccard(ab, bb),
        "translit_overlap": S.token_overlap(ab, bb),
        "translit_first_tok": _flag(first(ab) == first(bb)),
        "translit_char_3gram_jaccard": S.gram_jaccard(ab, bb, 3),
        "addr_lev": S.levenshtein_similarity(aa, ba),
        "addr_jaccard": S.token_jaccard(aa, ba),
        "addr_overlap": S.token_overlap(aa, ba),
        "addr_len_ratio": F.when(addressed, ratio(aa, ba)).otherwise(0.0),
        "addr_has_both": _flag(addressed),
        "addr_missing_cand": _flag(ba == ""),
        "addr_char_4gram_jaccard": S.gram_jaccard(aa, ba, 4),
        "postal_match": _matched(F.col("a_postal_code"), F.col("b_postal_code")),
        "postal_prefix_match": _matched(F.col("a_postal_prefix_3"), F.col("b_postal_prefix_3")),
        "street_num_match": _matched(F.col("a_street_number"), F.col("b_street_number")),
        "city_exact_match": _flag((F.col("a_city") != "") & (F.col("a_city") == F.col("b_city"))),
        "postal_log_freq": F.log1p("postal_freq"),
        "city_log_freq": F.log1p("city_freq"),
        "has_postal_both": _flag(postal_both),
        "name_len_ratio": F.when(named, ratio(an, bn)).otherwise(0.0),
        "name_char_diff": F.abs(length(an) - length(bn)).cast("double"),
        "name_token_diff": F.abs(F.size(words(an)) - F.size(words(bn))).cast("double"),
        "name_log_freq_s1": F.log1p("name_freq_a"),
        "name_log_freq_cand": F.log1p("name_freq_b"),
        "name_is_generic": _flag(F.col("name_freq_a") > GENERIC_NAME),
        "source_is_s2": _flag(F.lower("cand_id").startswith("s2")),
        "source_is_s3": _flag(F.lower("cand_id").startswith("s3")),
        "tfidf_score": F.lit(0.0),
        "tfidf_rank": F.lit(99.0),
        "blocking_channel_count": F.col("channel_count").cast("double"),
        "num_candidates": F.col("num_candidates").cast("double"),
    }


def combined_features() -> dict[str, Column]:
    jw, aj, aw = F.col("name_jw"), F.col("addr_jaccard"), F.col("addr_jw")
    most, least = F.greatest("name_jw", "name_token_sort_ratio", "translit_jw"), F.least("name_jw", "name_jaccard")
    return {
        "name_addr_prod": jw * aj,
        "name_addr_sum": (jw + aw) / 2,
        "name_postal_prod": F.when(F.col("postal_match") == 1, jw).otherwise(0.0),
        "name_jw_x_addr_missing": jw * F.col("addr_missing_cand"),
        "max_name_sim": most,
        "min_name_sim": least,
        "name_sim_range": most - least,
        "addr_sim_harmonic": 2 * aw * aj / (aw + aj + 1e-6),
    }

"""Blocking keys of normalized records, and the channels they make up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import constants as C
from ravelin.functions.normalize import squeeze

SEPARATOR = "\u0001"


def city_canon(city: Column) -> Column:
    for old, new in C.CITY_NAMES.items():
        city = F.regexp_replace(city, rf"\b{old}\b", new)
    return city


def _state_pattern(table: dict[str, str]) -> str:
    return r"\b(" + "|".join(sorted(table, key=len, reverse=True)) + r")\b"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(""))


def state_code(addr: Column, country: Column) -> Column:
    """The leftmost state in an address; US states in the US, Indian ones elsewhere."""
    us, india = (_lookup(t, F.regexp_extract(addr, _state_pattern(t), 1)) for t in (C.US_STATES, C.INDIAN_STATES))
    return F.when(country == "US", us).otherwise(india)


def without(text: Column, stop: str, kept: str = r"[^a-z0-9\s]") -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(text, stop, " "), kept, " "))


def token(text: Column, i: int) -> Column:
    """The i-th piece between single spaces; null beyond the last."""
    return F.get(F.split(text, " "), F.lit(i))


def with_keys(df: DataFrame) -> DataFrame:
    """Add the single-valued key columns."""
    name, blocking, addr = F.col("name_norm"), F.col("name_blocking"), F.col("addr_norm")
    number = F.when(F.col("street_number") != "", F.col("street_number")).otherwise(F.regexp_extract(addr, r"\b([0-9]{1,5})\b", 1))
    tags = F.regexp_replace(F.regexp_replace(F.regexp_replace(blocking, r"#\s*[0-9]+", " "), r"^[>\s«<]+", ""), C.TITLES, " ")
    return df.withColumns(
        {
            "city_canon": city_canon(F.col("city")),
            "state_code": state_code(addr, F.col("country")),
            "name_prefix_2": F.substring(name, 1, 2),
            "name_prefix_3": F.substring(name, 1, 3),
            "name_prefix_4": F.substring(name, 1, 4),
            "postal_5": F.substring("postal_code", 1, 5),
            "a0": token(addr, 0),
            "a1": token(addr, 1),
            "a2": token(addr, 2),
            "name_second_token": token(name, 1),
            "name_2tok": F.array_join(F.slice(F.split(name, " "), 1, 2), " "),
            "street_num_clean": F.ltrim(F.regexp_extract(number, "([0-9]+)", 1), F.lit("0")),
            "addr_feature_word": token(without(addr, C.FEATURE_STOP, r"[^a-z\s]"), 0),
            "name_indic_clean": without(blocking, C.INDIC_LEGAL),
            "name_org_clean": without(blocking, C.ORGANISATION),
            "name_clean": F.regexp_replace(F.regexp_replace(blocking, C.BUSINESS, ""), "[^a-z0-9]", ""),
            "name_col": F.regexp_replace(blocking, "[^a-z0-9]", ""),
            "name_title_clean": without(blocking, C.TITLES, r"[^a-z\s]"),
            "name_tag_clean": without(tags, C.BUSINESS),
        }
    )


@dataclass(frozen=True)
class Channel:
    """Key columns, the one whose length counts, its least length, and how many targets a key may have."""

    name: str
    columns: tuple[str, ...]
    measured: str
    least: int
    cap: int
    weight: int = 0


#: Channels that count one hit each
SINGLE = [
    Channel("1", ("name_norm",), "name_norm", 3, 250),
    Channel("1b", ("state_code", "name_norm"), "name_norm", 3, 150),
    Channel("2", ("name_clean",), "name_clean", 4, 200),
    Channel("2b", ("name_org_clean",), "name_org_clean", 4, 150),
    Channel("3", ("name_col",), "name_col", 4, 150),
    Channel("4", ("name_sorted_tokens",), "name_sorted_tokens", 4, 150),
    Channel("5", ("city", "street_num_clean"), "city", 3, 60),
    Channel("6", ("city", "name_first_token"), "name_first_token", 3, 60),
    Channel("7", ("city", "name_prefix_3"), "name_prefix_3", 3, 50),
    Channel("8", ("city", "name_prefix_2"), "name_prefix_2", 2, 40),
    Channel("9", ("city", "a0"), "a0", 4, 40),
    Channel("10", ("city", "a1"), "a1", 4, 40),
    Channel("11", ("city", "a2"), "a2", 4, 40),
    Channel("12", ("postal_5", "street_num_clean"), "postal_5", 4, 50),
    Channel("13", ("postal_5", "name_first_token"), "postal_5", 4, 50),
    Channel("14", ("postal_5", "name_prefix_2"), "postal_5", 4, 50),
    Channel("15", ("city", "name_prefix_4"), "name_prefix_4", 4, 50),
    Channel("16", ("city", "name_second_token"), "name_second_token", 3, 50),
    Channel("17", ("postal_5", "name_prefix_3"), "postal_5", 4, 50),
    Channel("18", ("postal_5", "name_prefix_4"), "postal_5", 4, 50),
    Channel("19", ("city", "addr_feature_word"), "addr_feature_word", 3, 50),
    Channel("20", ("street_num_clean", "addr_feature_word"), "addr_feature_word", 3, 50),
    Channel("21", ("postal_5", "addr_feature_word"), "addr_feature_word", 3, 50),
    Channel("22", ("name_title_clean",), "name_title_clean", 4, 200),
    Channel("23", ("name_2tok",), "name_2tok", 5, 100),
    Channel("28", ("city_canon", "street_num_clean"), "city_canon", 3, 60),
    Channel("29", ("name_indic_clean",), "name_indic_clean", 4, 150),
    Channel("30", ("state_code", "name_first_token"), "name_first_token", 4, 40),
    Channel("30b", ("state_code", "name_prefix_3"), "name_prefix_3", 3, 40),
    Channel("31", ("state_code", "street_num_clean"), "state_code", 2, 50),
    Channel("32", ("state_code", "addr_feature_word"), "addr_feature_word", 3, 50),
]
#: Channels of many keys a record, whose hit counts as their weight: name, cap, weight
MANY = {"24": (40, 3), "25": (75, 2), "26": (60, 3), "26b": (80, 3), "27": (40, 2), "33": (80, 3), "34": (120, 3), "35": (30, 3), "36": (50, 3), "37": (40, 3), "38": (30, 3), "39": (40, 3)}
CAPS = {c.name: c.cap for c in SINGLE} | {n: cap for n, (cap, _) in MANY.items()}
WEIGHTS = {n: w for n, (_, w) in MANY.items()}


def single_key(c: Channel) -> Column:
    """A channel's key, or null where a part is missing or too short."""
    ok = F.length(c.measured) >= c.least
    for column in c.columns:
        ok = ok & (F.col(column) != "")
    return F.when(ok, F.concat_ws(SEPARATOR, *c.columns))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws(SEPARATOR, a, b)


def many_keys() -> dict[str, Column]:
    """An array of keys for each of :data:`MANY`. Where a record's repeats count towards a cap, they are left in."""
    addr, raw = F.col("addr_norm"), F.lower("business_address")
    address_words = F.split(without(addr, C.ADDRESS_STOP, r"[^a-z\s]"), " ")
    name_words = F.split(without(F.col("name_blocking"), C.NAME_STOP, r"[^a-z\s]"), " ")
    long = lambda n: lambda w: F.length(w) >= n
    codes = F.filter(F.transform(_all(addr, C.BUILDING_CODE), lambda c: F.regexp_replace(c, r"[\s\-_/]+", "")), long(2))
    state, town, canon = F.col("state_code"), F.col("city"), F.col("city_canon")
    none = F.expr("cast(array() as array<string>)")
    only = lambda ok, keys: F.when(ok, keys).otherwise(none)
    numbers = F.slice(_all(addr, r"\b0*[0-9]{1,6}\b"), 1, 3)
    first_words = F.filter(F.slice(address_words, 1, 3), long(4))
    bigrams = F.filter(F.zip_with(address_words, F.slice(address_words, 2, F.size(address_words)), lambda a, b: F.when((F.length(a) >= 3) & (F.length(b) >= 3), F.concat_ws(" ", a, b))), lambda x: x.isNotNull())
    anchors = F.transform(_all(raw, C.ANCHOR), lambda a: F.trim(F.regexp_replace(a, r"[\s/]+", "-"), F.lit("-")))
    anchor = lambda n: F.array_distinct(F.filter(anchors, lambda a: (F.length(a) >= n) & a.rlike("[0-9]")))
    return {
        "24": only(F.length("name_first_token") >= 5, F.array("name_first_token")),
        "25": F.filter(address_words, long(4)),
        "26": codes,
        "26b": only(state != "", F.transform(codes, lambda c: _pair(state, c))),
        "27": only(town != "", F.transform(_all(addr, r"\b0*[0-9]{2,5}\b"), lambda n: _pair(town, n))),
        "33": F.array_distinct(bigrams),
        "34": only(F.length("name_tag_clean") >= 4, F.array("name_tag_clean")),
        "35": F.array_distinct(F.flatten(F.transform(numbers, lambda n: F.transform(first_words, lambda w: _pair(n, w))))),
        "36": F.filter(_all(raw, C.PLOT), long(3)),
        "37": only(canon != "", F.transform(anchor(2), lambda a: _pair(canon, a))),
        "38": only(state != "", F.transform(anchor(3), lambda a: _pair(state, a))),
        "39": F.filter(name_words, long(4)),
    }


def key_table(normalized: DataFrame, channels: list[str] | None = None, once: bool = False) -> DataFrame:
    """One row for each key of each record: ``country, channel, key, entity_id``. All channels come from one scan. ``once``: a key that a record has several times in a channel comes once."""
    wanted = set(CAPS) if channels is None else set(channels)
    if unknown := wanted - set(CAPS):
        raise ValueError(f"no such channels: {sorted(unknown)}")
    df = with_keys(normalized)
    one = [F.struct(F.lit(c.name).alias("channel"), single_key(c).alias("key")) for c in SINGLE if c.name in wanted]
    parts = [F.array(*one)] if one else []
    for name, keys in many_keys().items():
        if name in wanted:
            parts.append(_tagged(name, F.array_distinct(keys) if once else keys))
    exploded = df.select("country", "entity_id", F.explode(F.concat(*parts)).alias("k"))
    return exploded.where(F.col("k.key").isNotNull()).select("country", "k.channel", "k.key", "entity_id")


def _tagged(name: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(name).alias("channel"), k.alias("key")))

"""Text normalization of records as column expressions; no step leaves the JVM.

Nulls become the empty string, which stands for "missing" everywhere below. Text is folded to ASCII: Indic scripts are transliterated, Latin letters lose their
marks, and what is left of other scripts is removed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import constants as C

_MANY = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", " ": " ", "°": "deg"}


def _marked() -> dict[str, str]:
    """Lower-case Latin letters with marks, and the letters below the marks, by Unicode's decomposition."""
    out = {}
    for code in range(0xE0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.islower():
            out[chr(code)] = base
    return out


MARKED = _marked()

# The ITRANS scheme, by offset in a block of the shared layout (0x05 is the first vowel, 0x15 the first consonant)
_VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
_CONSONANTS = "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n n p ph b bh m y r R l L zh v sh Sh s h".split()
_SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x4D: ""}
_MARKS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3C: "", 0x64: "|", 0x65: "||"} | {0x66 + i: str(i) for i in range(10)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def transliterate(text: Column) -> Column:
    """Indic scripts as ITRANS. The nine blocks share one layout, so all are moved onto the first; a consonant without a vowel sign sounds an ``a``."""
    offsets = range(0x80)
    others = "".join(chr(0x0900 + 0x80 * block + o) for block in range(1, 9) for o in offsets)
    out = F.translate(text, others, "".join(chr(0x0900 + o) for o in offsets) * 8)
    out = F.regexp_replace(out, "([क-ह]़?)(?![़ा-्])", "$1अ")
    for offset, latin in [*_VOWELS.items(), *((0x15 + i, c) for i, c in enumerate(_CONSONANTS)), *_SIGNS.items(), *_MARKS.items()]:
        out = F.replace(out, F.lit(chr(0x0900 + offset)), F.lit(latin))
    return F.when(text.rlike("[ऀ-ൿ]"), out).otherwise(text)


def fold(text: Column) -> Column:
    """Lower-case ASCII, but for upper-case letters that :func:`transliterate` made of already lower-case text."""
    out = F.translate(text, "".join(MARKED), "".join(MARKED.values()))
    for a, b in _MANY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.regexp_replace(out, "[^\\x00-\\x7F]", "")).otherwise(text)


def plain(text: Column) -> Column:
    return let(let(text, transliterate), fold)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def deconstruct_url(name: Column) -> Column:
    """The words of an address in the web: no scheme, no www, no top-level domain; other names stay."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, C.URL, ""), C.TLD, ""), r"[/_.\-]+", " ")
    ends = F.lower(name).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in C.DOMAIN_ENDINGS) + ")$")
    return F.when(name.rlike(C.URL) | ends, F.trim(bare)).otherwise(name)


def name_blocking(name: Column) -> Column:
    folded = let(F.lower(let(let(present(name), deconstruct_url), transliterate)), fold)
    spaced = F.regexp_replace(F.replace(F.replace(folded, F.lit("&"), F.lit(" and ")), F.lit("-"), F.lit(" ")), "['\"]", "")
    return squeeze(F.regexp_replace(spaced, r"[^a-z0-9_\s]", " "))


_SUFFIX = r"(?i)\b(?:" + "|".join(s.replace(".", r"\.") for s in sorted(C.LEGAL_SUFFIXES, key=len, reverse=True)) + r")\.?\b"


def name_norm(blocking: Column) -> Column:
    return squeeze(F.regexp_replace(blocking, _SUFFIX, ""))


def words(text: Column) -> Column:
    """Its words; none for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def sorted_tokens(norm: Column) -> Column:
    return F.array_join(F.array_sort(F.array_except(F.array_distinct(words(norm)), F.array(*[F.lit(w) for w in C.STOPWORDS]))), " ")


def has_address(address: Column) -> Column:
    return (present(address) != "") & ~F.lower(present(address)).isin(C.NO_ADDRESS)


def addr_norm(address: Column) -> Column:
    out = F.regexp_replace(plain(F.trim(F.lower(present(address)))), C.LANDMARK, "")

    def expand(short: str, long: str) -> Callable[[Column], Column]:
        pattern = r"(?i)\b" + short.replace(".", r"\.") + r"\b"
        # a plain search spares a text the abbreviations that it does not have
        return lambda text: F.when(F.contains(F.lower(text), F.lit(short)), F.regexp_replace(text, pattern, long)).otherwise(text)

    for short, long in C.ADDRESS_WORDS.items():
        out = let(out, expand(short, long))
    out = squeeze(F.regexp_replace(out, r"[^A-Za-z0-9_\s,]", " "))
    return F.when(has_address(address), out).otherwise("")


def postal_code(address: Column, country: Column) -> Column:
    a, out = present(address), None
    for name, pattern in C.POSTAL.items():
        hit = F.regexp_extract(a, pattern, 1)
        out = F.when(country == name, hit) if out is None else out.when(country == name, hit)
    return F.when(has_address(address), out.otherwise(F.regexp_extract(a, C.POSTAL_ELSEWHERE, 1))).otherwise("")


def city(address: Column) -> Column:
    """Of three or more parts between commas the last but one, of two the last; without digits, and longer than two letters."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(present(address), ","), strip), lambda p: p != "")
    chosen = F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 2)).when(F.size(parts) == 2, F.get(parts, F.lit(1)))
    bare = strip(F.regexp_replace(chosen, "[0-9]+", ""))
    return F.when(has_address(address) & (F.length(bare) > 2), F.lower(bare)).otherwise("")


def street_number(address: Column) -> Column:
    return F.when(has_address(address), F.regexp_extract(present(address), r"^\s*([0-9]+)", 1)).otherwise("")


def normalize(records: DataFrame) -> DataFrame:
    """Add the ten derived columns to records. A missing ``country`` column or value is the empty string."""
    if "country" not in records.columns:
        records = records.withColumn("country", F.lit(""))
    out = records.withColumns({c: present(F.col(c)) for c in ("business_name", "business_address", "country")})
    out = out.withColumns({"name_blocking": name_blocking(F.col("business_name")), "addr_norm": addr_norm(F.col("business_address")), "postal_code": postal_code(F.col("business_address"), F.col("country")), "city": city(F.col("business_address")), "street_number": street_number(F.col("business_address"))})
    out = out.withColumn("name_norm", name_norm(F.col("name_blocking")))
    return out.withColumns(
        {
            "name_sorted_tokens": sorted_tokens(F.col("name_norm")),
            "name_first_token": F.split_part("name_norm", F.lit(" "), F.lit(1)),
            "postal_prefix_3": F.substring("postal_code", 1, 3),
            "addr_missing": (F.col("addr_norm") == "").cast("int"),
        }
    )

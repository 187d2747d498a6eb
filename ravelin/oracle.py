"""DuckDB SQL for the record-linkage queries, built from the same fixed values."""

from __future__ import annotations

from ravelin.functions import constants as C
from ravelin.functions.normalize import _MANY, MARKED
from ravelin.operators.keys import CAPS, SINGLE, WEIGHTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def fold(x: str) -> str:
    out = f"translate({x}, {q(''.join(MARKED))}, {q(''.join(MARKED.values()))})"
    for a, b in _MANY.items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    return sub(out, r"[^\x00-\x7F]")


def url(x: str) -> str:
    ends = "(?:" + "|".join(e.replace(".", r"\.") for e in C.DOMAIN_ENDINGS) + ")$"
    bare = sub(sub(sub(x, C.URL), C.TLD), r"[/_.\-]+", " ")
    return f"case when regexp_matches({x}, {q(C.URL)}) or regexp_matches(lower({x}), {q(ends)}) then trim({bare}) else {x} end"


SUFFIX = r"(?i)\b(?:" + "|".join(s.replace(".", r"\.") for s in sorted(C.LEGAL_SUFFIXES, key=len, reverse=True)) + r")\.?\b"


def _blocking(x: str) -> str:
    return squeeze(sub(sub(f"replace(replace({x}, '&', ' and '), '-', ' ')", "['\"]"), r"[^a-z0-9_\s]", " "))


def _addr(x: str) -> str:
    out = sub(x, C.LANDMARK)
    for short, long in C.ADDRESS_WORDS.items():
        out = sub(out, r"(?i)\b" + short.replace(".", r"\.") + r"\b", long)
    return squeeze(sub(out, r"[^A-Za-z0-9_\s,]", " "))


def _postal(x: str) -> str:
    whens = " ".join(f"when country = {q(n)} then regexp_extract({x}, {q(p)}, 1)" for n, p in C.POSTAL.items())
    return f"case {whens} else regexp_extract({x}, {q(C.POSTAL_ELSEWHERE)}, 1) end"


DOCUMENTS = r"""rec as (select 'S' || (doc_id % 3 + 1) || '-' || doc_id entity_id, array_to_string(t[1:6], ' ') business_name, array_to_string(t[7:], ' ') business_address,
  case lang when 'en' then 'US' when 'fr' then 'France' when 'es' then 'India' else coalesce(lang, '') end country
  from (select *, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') t from documents))"""

PARTS = r"""rec as (select 'S' || (p_partkey % 3 + 1) || '-' || p_partkey entity_id,
  p_name || ' ' || lower(p_type) || [' Ltd', ' Inc.', '', ' Enterprises'][(p_partkey % 4 + 1)::int] business_name,
  case when p_partkey % 11 = 0 then 'N/A' else p_size || ' ' || replace(p_brand, '#', ' ') || ' St, Near ' || lower(p_type) || ' depot, '
    || ['Springfield', 'Mumbai', 'Lyon', 'Austin', 'Bangalore'][p_size % 5 + 1] || ', ' || ['TX', 'MH', 'Rhone', 'TX', 'Karnataka'][p_size % 5 + 1] || ' ' || (p_size * 137 + 410000) end business_address,
  ['US', 'India', 'France', 'US', 'India'][p_size % 5 + 1] country from part)"""

TRUTH = """truth as (select a.id s1_id, b.id cand_id from p a join p b using (p_name, p_size, p_brand) where a.id like 'S1-%' and b.id not like 'S1-%')"""
_P = "p as (select p_name, p_size, p_brand, 'S' || (p_partkey % 3 + 1) || '-' || p_partkey id from part)"

_CITY = "list_filter(list_transform(string_split(business_address, ','), lambda x: trim(x)), lambda x: x <> '')"
_HAS = f"business_address <> '' and lower(business_address) not in ({', '.join(map(q, C.NO_ADDRESS))})"
_STOP = "[" + ", ".join(map(q, C.STOPWORDS)) + "]"

NORM = f"""
n1 as (select *, {fold(f"lower({url('business_name')})")} folded, {fold("trim(lower(business_address))")} afolded, {_HAS} has_addr from rec),
n2 as (select *, {_blocking('folded')} name_blocking, case when has_addr then {_addr('afolded')} else '' end addr_norm,
  case when has_addr then {_postal('business_address')} else '' end postal_code,
  case when has_addr then regexp_extract(business_address, '^\\s*([0-9]+)', 1) else '' end street_number,
  trim(regexp_replace(case when len({_CITY}) >= 3 then {_CITY}[-2] when len({_CITY}) = 2 then {_CITY}[2] end, '[0-9]+', '', 'g')) bare_city from n1),
n3 as (select *, {squeeze(sub('name_blocking', SUFFIX))} name_norm, case when has_addr and length(bare_city) > 2 then lower(bare_city) else '' end city from n2),
norm as (select entity_id, business_name, business_address, country, name_blocking, name_norm, addr_norm, postal_code, left(postal_code, 3) postal_prefix_3, city, street_number,
  array_to_string(list_sort(list_filter(list_distinct(string_split(name_norm, ' ')), lambda x: x <> '' and not list_contains({_STOP}, x))), ' ') name_sorted_tokens,
  split_part(name_norm, ' ', 1) name_first_token, (addr_norm = '')::int addr_missing from n3)"""


def _state(table: dict[str, str]) -> str:
    pattern = r"\b(" + "|".join(sorted(table, key=len, reverse=True)) + r")\b"
    pairs = ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items())
    return f"coalesce(map {{{pairs}}}[regexp_extract(addr_norm, {q(pattern)}, 1)], '')"


def _without(x: str, stop: str, kept: str = r"[^a-z0-9\s]") -> str:
    return squeeze(sub(sub(x, stop, " "), kept, " "))


def _canon(x: str) -> str:
    for old, new in C.CITY_NAMES.items():
        x = sub(x, rf"\b{old}\b", new)
    return x


_NUMBER = r"case when street_number <> '' then street_number else regexp_extract(addr_norm, '\b([0-9]{1,5})\b', 1) end"
KEYED = f"""
keyed as (select *, {_canon('city')} city_canon, case when country = 'US' then {_state(C.US_STATES)} else {_state(C.INDIAN_STATES)} end state_code,
  left(name_norm, 2) name_prefix_2, left(name_norm, 3) name_prefix_3, left(name_norm, 4) name_prefix_4, left(postal_code, 5) postal_5,
  string_split(addr_norm, ' ')[1] a0, string_split(addr_norm, ' ')[2] a1, string_split(addr_norm, ' ')[3] a2, string_split(name_norm, ' ')[2] name_second_token,
  array_to_string(string_split(name_norm, ' ')[1:2], ' ') name_2tok, ltrim({_NUMBER}, '0') street_num_clean,
  string_split({_without('addr_norm', C.FEATURE_STOP, '[^a-z' + chr(92) + 's]')}, ' ')[1] addr_feature_word,
  {_without('name_blocking', C.INDIC_LEGAL)} name_indic_clean, {_without('name_blocking', C.ORGANISATION)} name_org_clean,
  {sub(sub('name_blocking', C.BUSINESS), '[^a-z0-9]')} name_clean, {sub('name_blocking', '[^a-z0-9]')} name_col, {_without('name_blocking', C.TITLES, '[^a-z' + chr(92) + 's]')} name_title_clean,
  {_without(sub(sub(sub('name_blocking', '#' + chr(92) + 's*[0-9]+', ' '), '^[>' + chr(92) + 's«<]+'), C.TITLES, ' '), C.BUSINESS)} name_tag_clean
  from norm)"""


def _single(c) -> str:
    ok = f"length({c.measured}) >= {c.least} and " + " and ".join(f"{x} <> ''" for x in c.columns)
    return f"select country, entity_id, {q(c.name)} channel, concat_ws(chr(1), {', '.join(c.columns)}) key from keyed where {ok}"


def _many() -> dict[str, str]:
    words = f"string_split({_without('addr_norm', C.ADDRESS_STOP, '[^a-z' + chr(92) + 's]')}, ' ')"
    names = f"string_split({_without('name_blocking', C.NAME_STOP, '[^a-z' + chr(92) + 's]')}, ' ')"
    every = lambda x, p: f"regexp_extract_all({x}, {q(p)})"
    raw = "lower(business_address)"
    rows = lambda expr, where="true": f"select country, entity_id, unnest({expr}) k, state_code, city, city_canon from keyed where {where}"
    codes = rows(f"list_transform({every('addr_norm', C.BUILDING_CODE)}, lambda c: {sub('c', '[' + chr(92) + 's' + chr(92) + '-_/]+')})")
    anchors = rows(f"list_transform({every(raw, C.ANCHOR)}, lambda a: trim({sub('a', '[' + chr(92) + 's/]+', '-')}, '-'))")
    pick = lambda source, key="k", where="true", once="": f"select {once} country, entity_id, {key} key from ({source}) where {where}"
    joined = lambda a: f"concat_ws(chr(1), {a}, k)"
    return {
        "24": "select country, entity_id, name_first_token key from keyed where length(name_first_token) >= 5",
        "25": pick(rows(words), where="length(k) >= 4"),
        "26": pick(codes, where="length(k) >= 2"),
        "26b": pick(codes, joined("state_code"), "length(k) >= 2 and state_code <> ''"),
        "27": pick(rows(every("addr_norm", r"\b0*[0-9]{2,5}\b")), joined("city"), "city <> ''"),
        "33": f"select distinct country, entity_id, w[i] || ' ' || w[i + 1] key from (select country, entity_id, {words} w from keyed), unnest(range(1, len(w))) t(i) where length(w[i]) >= 3 and length(w[i + 1]) >= 3",
        "34": "select country, entity_id, name_tag_clean key from keyed where length(name_tag_clean) >= 4",
        "35": f"select distinct country, entity_id, concat_ws(chr(1), n, w) key from (select country, entity_id, unnest({every('addr_norm', chr(92) + 'b0*[0-9]{1,6}' + chr(92) + 'b')}[1:3]) n, {words} ws from keyed), unnest(ws[1:3]) t(w) where length(w) >= 4",
        "36": pick(rows(every(raw, C.PLOT)), where="length(k) >= 3"),
        "37": pick(anchors, joined("city_canon"), "city_canon <> '' and length(k) >= 2 and regexp_matches(k, '[0-9]')", "distinct"),
        "38": pick(anchors, joined("state_code"), "state_code <> '' and length(k) >= 3 and regexp_matches(k, '[0-9]')", "distinct"),
        "39": pick(rows(names), where="length(k) >= 4"),
    }


def keys(channels: list[str]) -> str:
    many = _many()
    parts = [_single(c) for c in SINGLE if c.name in channels] + [f"select country, entity_id, {q(n)} channel, key from ({s})" for n, s in many.items() if n in channels]
    caps = ", ".join(f"({q(n)}, {CAPS[n]}, {WEIGHTS.get(n, 0)})" for n in channels)
    return f""",
caps(channel, cap, weight) as (values {caps}),
k as materialized ({' union all '.join(parts)}),
few as (select country, channel, key from k join caps using (channel) where entity_id not like 'S1-%' group by country, channel, key, cap having count(*) <= cap),
hits as (select distinct a.country, a.channel, a.key, a.entity_id s1_id, b.entity_id cand_id from k a join few using (country, channel, key) join k b using (country, channel, key)
  where a.entity_id like 'S1-%' and b.entity_id not like 'S1-%'),
counted as (select country, s1_id, cand_id, greatest(sum((weight = 0)::int), max(weight))::bigint channel_count from hits join caps using (channel) group by all),
pool as (select * from (select *, row_number() over (partition by country, s1_id order by channel_count desc, cand_id) r from counted) where r <= 180)"""


def base(records: str, channels: list[str] | None = None, keyed: bool = False) -> str:
    return f"with {records}, {NORM}" + (f", {KEYED}" if keyed or channels else "") + (keys(channels) if channels else "")


ALL = list(CAPS)
FREQUENCY = """, pairs as (select *, count(*) over (partition by country, s1_id) num_candidates from pool),
f as (select s1_id, cand_id, channel_count, num_candidates, r, a.country, a.name_norm an, b.name_norm bn, a.name_blocking ab, b.name_blocking bb, a.addr_norm aa, b.addr_norm ba, a.postal_code ap, b.postal_code bp,
  a.postal_prefix_3 ap3, b.postal_prefix_3 bp3, a.city ac, b.city bc, a.street_number asn, b.street_number bsn from pairs join norm a on a.entity_id = s1_id join norm b on b.entity_id = cand_id where r <= 30)"""


def words(x: str) -> str:
    return f"list_filter(list_distinct(string_split({x}, ' ')), lambda w: w <> '')"


def jaccard(x: str, y: str) -> str:
    return f"case when len({x}) > 0 and len({y}) > 0 then len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) else 0.0 end"


def overlap(x: str, y: str) -> str:
    return f"case when least(len({x}), len({y})) > 0 then len(list_intersect({x}, {y})) / least(len({x}), len({y})) else 0.0 end"


def grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), lambda i: {x}[i : i + {n - 1}]))"


def lev(x: str, y: str) -> str:
    return f"case when {x} <> '' and {y} <> '' then 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})) else 0.0 end"


def jw(x: str, y: str) -> str:
    return f"case when {x} <> '' and {y} <> '' then jaro_winkler_similarity({x}, {y}) else 0.0 end"

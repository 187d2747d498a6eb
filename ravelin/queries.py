"""The registered record-linkage queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import oracle as O
from ravelin.functions import similarity as S
from ravelin.functions.normalize import deconstruct_url, normalize
from ravelin.operators import blocking, features, keys, matching, metrics, model, validate
from ravelin.scratch import materialize
from ravelin.sources import adapters, tables

#: (query, SQL or None)
_made: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        _made[f.__name__] = (f, sql)
        return f

    return add


def _documents(spark, sf_dir) -> DataFrame:
    return normalize(adapters.document_records(spark, sf_dir))


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return adapters._split_sources(materialize(normalize(adapters.part_records(spark, sf_dir)), "records"))


def _pool(spark, sf_dir, channels=None) -> DataFrame:
    return blocking.candidates(*_parts(spark, sf_dir), channels)


def _select(columns: str, keyed: bool = False, records: str = O.DOCUMENTS) -> str:
    return f"{O.base(records, keyed=keyed)} select {columns} from {'keyed' if keyed else 'norm'}"


@_query(_select("entity_id, name_blocking, name_norm, name_first_token"))
def normalize_names(spark, sf_dir):
    return _documents(spark, sf_dir).select("entity_id", "name_blocking", "name_norm", "name_first_token")


@_query(_select("entity_id, addr_norm, addr_missing"))
def normalize_address(spark, sf_dir):
    return _documents(spark, sf_dir).select("entity_id", "addr_norm", "addr_missing")


@_query(_select("entity_id, postal_code, postal_prefix_3"))
def extract_postal(spark, sf_dir):
    return _documents(spark, sf_dir).select("entity_id", "postal_code", "postal_prefix_3")


@_query(_select("entity_id, city"))
def extract_city(spark, sf_dir):
    return _documents(spark, sf_dir).select("entity_id", "city")


@_query(_select("entity_id, street_number", records=O.PARTS))
def street_number(spark, sf_dir):
    return normalize(adapters.part_records(spark, sf_dir)).select("entity_id", "street_number")


@_query(_select("entity_id, name_sorted_tokens"))
def sorted_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("entity_id", "name_sorted_tokens")


@_query(f"select page_id, {O.url('url')} name from pages")
def url_deconstruct(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", deconstruct_url(F.col("url")).alias("name"))


_PREFIX = ["name_prefix_2", "name_prefix_3", "name_prefix_4", "postal_5", "a0", "a1", "a2", "name_second_token", "name_2tok", "street_num_clean", "addr_feature_word"]


@_query(_select(", ".join(["entity_id", *_PREFIX]), keyed=True))
def prefix_keys(spark, sf_dir):
    return keys.with_keys(_documents(spark, sf_dir)).select("entity_id", *_PREFIX)


_CLEAN = ["name_indic_clean", "name_org_clean", "name_clean", "name_col", "name_title_clean", "name_tag_clean"]


@_query(_select(", ".join(["entity_id", *_CLEAN]), keyed=True, records=O.PARTS))
def name_keys(spark, sf_dir):
    return keys.with_keys(normalize(adapters.part_records(spark, sf_dir))).select("entity_id", *_CLEAN)


@_query(_select("entity_id, state_code, city_canon", keyed=True))
def state_code(spark, sf_dir):
    return keys.with_keys(_documents(spark, sf_dir)).select("entity_id", "state_code", "city_canon")


@_query(f"{O.base(O.PARTS, O.ALL)} select channel, count(distinct (country, key)) n_keys from few group by channel")
def key_frequency_cap(spark, sf_dir):
    few = blocking.capped(_parts(spark, sf_dir)[1])
    return few.select("channel", "country", "key").distinct().groupBy("channel").agg(F.count(F.lit(1)).alias("n_keys"))


@_query(f"{O.base(O.DOCUMENTS, ['1', '23'])} select distinct country, channel, s1_id, cand_id from hits")
def block_exact_name(spark, sf_dir):
    s1, targets = adapters._split_sources(materialize(_documents(spark, sf_dir), "records"))
    return blocking.hits(s1, targets, ["1", "23"]).distinct()


_SINGLES = [c.name for c in keys.SINGLE]


@_query(f"{O.base(O.DOCUMENTS, _SINGLES)} select country, s1_id, cand_id, channel_count from counted")
def block_tier1(spark, sf_dir):
    s1, targets = adapters._split_sources(materialize(_documents(spark, sf_dir), "records"))
    return blocking.channel_counts(blocking.hits(s1, targets, _SINGLES))


def _channel(name: str, channels: list[str]) -> None:
    def run(spark, sf_dir):
        found = blocking.hits(*_parts(spark, sf_dir), channels)
        return found.distinct()

    run.__name__ = name
    _query(f"{O.base(O.PARTS, channels)} select distinct country, channel, s1_id, cand_id from hits")(run)


for _name, _channels in {"block_tokens": ["24", "25", "39"], "block_codes": ["26", "26b"], "block_numbers": ["27", "35"], "block_shingles": ["33", "34"], "block_plots": ["36", "37", "38"]}.items():
    _channel(_name, _channels)


@_query(f"{O.base(O.PARTS, O.ALL)} select country, s1_id, cand_id, channel_count from counted")
def channel_count(spark, sf_dir):
    return blocking.channel_counts(blocking.hits(*_parts(spark, sf_dir)))


@_query(f"{O.base(O.PARTS, O.ALL)} select country, s1_id, cand_id, channel_count from pool")
def candidates_topk(spark, sf_dir):
    return _pool(spark, sf_dir)


@_query(f"{O.base(O.PARTS, O.ALL)}, {O._P}, {O.TRUTH}, t as (select n.country, pool.s1_id is not null hit from truth join norm n on n.entity_id = truth.s1_id left join pool using (s1_id, cand_id)) select country, count(*) n_links, sum(hit::int)::bigint n_found, round(sum(hit::int) / count(*), 6) recall from t group by rollup (country)")
def blocking_recall(spark, sf_dir):
    s1, targets = _parts(spark, sf_dir)
    return blocking.recall(blocking.candidates(s1, targets), adapters.part_truth(spark, sf_dir), s1)


def _pairs(spark, sf_dir) -> DataFrame:
    s1, targets = _parts(spark, sf_dir)
    return features.joined_pairs(features.top_pairs(blocking.candidates(s1, targets)), s1, targets)


def _pair_sql(columns: str, extra: str = "") -> str:
    return f"{O.base(O.PARTS, O.ALL)} {O.FREQUENCY}{extra} select s1_id, cand_id, {columns} from f"


def _rounded(expr: str, name: str) -> str:
    return f"round({expr}, 6) {name}"


def _native(names: list[str], sql: str | None, name: str, extra: str = "") -> None:
    def run(spark, sf_dir):
        of = features.native_features()
        return _pairs(spark, sf_dir).select("s1_id", "cand_id", *[F.round(of[n], 6).alias(n) for n in names])

    run.__name__ = name
    _query(_pair_sql(sql, extra) if sql else None)(run)


_native(["name_lev", "translit_lev", "addr_lev"], ", ".join(_rounded(O.lev(a, b), n) for a, b, n in (("an", "bn", "name_lev"), ("ab", "bb", "translit_lev"), ("aa", "ba", "addr_lev"))), "sim_levenshtein")
_native(["name_jaccard", "translit_jaccard", "addr_jaccard"], ", ".join(_rounded(O.jaccard(O.words(a), O.words(b)), n) for a, b, n in (("an", "bn", "name_jaccard"), ("ab", "bb", "translit_jaccard"), ("aa", "ba", "addr_jaccard"))), "sim_jaccard")
_native(["name_overlap", "translit_overlap", "addr_overlap"], ", ".join(_rounded(O.overlap(O.words(a), O.words(b)), n) for a, b, n in (("an", "bn", "name_overlap"), ("ab", "bb", "translit_overlap"), ("aa", "ba", "addr_overlap"))), "sim_overlap")
_native(["name_char_3gram_jaccard", "translit_char_3gram_jaccard", "addr_char_4gram_jaccard"], ", ".join(_rounded(O.jaccard(O.grams(a, n), O.grams(b, n)), name) for a, b, n, name in (("an", "bn", 3, "name_char_3gram_jaccard"), ("ab", "bb", 3, "translit_char_3gram_jaccard"), ("aa", "ba", 4, "addr_char_4gram_jaccard"))), "sim_ngram")


def _match_sql(a: str, b: str) -> str:
    return f"case when {a} = '' or {b} = '' then -1.0 else ({a} = {b})::int::double end"


_native(
    ["postal_match", "postal_prefix_match", "street_num_match", "city_exact_match", "has_postal_both", "addr_has_both", "addr_missing_cand", "name_first_tok", "name_contains", "name_len_ratio", "addr_len_ratio", "name_char_diff", "name_prefix_len", "source_is_s2", "num_candidates"],
    f"""{_match_sql('ap', 'bp')} postal_match, {_match_sql('ap3', 'bp3')} postal_prefix_match, {_match_sql('asn', 'bsn')} street_num_match, (ac <> '' and ac = bc)::int::double city_exact_match,
    (ap <> '' and bp <> '')::int::double has_postal_both, (aa <> '' and ba <> '')::int::double addr_has_both, (ba = '')::int::double addr_missing_cand,
    (an <> '' and split_part(an, ' ', 1) = split_part(bn, ' ', 1))::int::double name_first_tok, (an <> '' and bn <> '' and (contains(an, bn) or contains(bn, an)))::int::double name_contains,
    round(case when an <> '' and bn <> '' then least(length(an), length(bn)) / greatest(length(an), length(bn)) else 0.0 end, 6) name_len_ratio,
    round(case when aa <> '' and ba <> '' then least(length(aa), length(ba)) / greatest(length(aa), length(ba)) else 0.0 end, 6) addr_len_ratio, abs(length(an) - length(bn))::double name_char_diff,
    round(len(list_filter(range(1, least(length(an), length(bn)) + 1), lambda i: left(an, i) = left(bn, i))) / greatest(length(an), length(bn), 1), 6) name_prefix_len,
    (cand_id like 'S2%')::int::double source_is_s2, num_candidates::double num_candidates""",
    "geo_flags",
)
_native(
    ["name_log_freq_s1", "name_log_freq_cand", "postal_log_freq", "city_log_freq", "name_is_generic"],
    """round(ln(1 + coalesce(n1.c, 1)), 6) name_log_freq_s1, round(ln(1 + coalesce(n2.c, 1)), 6) name_log_freq_cand, round(ln(1 + coalesce(p1.c, 0)), 6) postal_log_freq, round(ln(1 + coalesce(c1.c, 0)), 6) city_log_freq, (coalesce(n1.c, 1) > 50)::int::double name_is_generic""",
    "log_freqs",
    """, nf as (select country, name_norm v, count(*) c from norm group by all), pf as (select country, postal_code v, count(*) c from norm where postal_code <> '' group by all), cf as (select country, city v, count(*) c from norm where city <> '' group by all)""",
)
_made["log_freqs"] = (_made["log_freqs"][0], _made["log_freqs"][1] + " left join nf n1 on n1.country = f.country and n1.v = an left join nf n2 on n2.country = f.country and n2.v = bn left join pf p1 on p1.country = f.country and p1.v = ap left join cf c1 on c1.country = f.country and c1.v = ac")


@_query(_pair_sql(", ".join(_rounded(O.jw(a, b), n) for a, b, n in (("an", "bn", "name_jw"), ("ab", "bb", "translit_jw"), ("aa", "ba", "addr_jw"), ("ac", "bc", "city_sim")))))
def sim_jaro_winkler(spark, sf_dir):
    pairs = (("a_name_norm", "b_name_norm", "name_jw"), ("a_name_blocking", "b_name_blocking", "translit_jw"), ("a_addr_norm", "b_addr_norm", "addr_jw"), ("a_city", "b_city", "city_sim"))
    return _pairs(spark, sf_dir).select("s1_id", "cand_id", *[F.round(S.jaro_winkler(a, b), 6).alias(n) for a, b, n in pairs])


@_query()
def sim_token_ratios(spark, sf_dir):
    a, b = "a_name_norm", "b_name_norm"
    return _pairs(spark, sf_dir).select("s1_id", "cand_id", *[F.round(f(a, b), 6).alias(n) for f, n in ((S.token_sort_ratio, "sort_ratio"), (S.token_set_ratio, "set_ratio"), (S.lcs_ratio, "lcs_ratio"))])


_PRODUCTS = ["name_last_tok", "translit_first_tok", "name_token_diff", "name_addr_prod", "name_addr_sum", "name_postal_prod", "name_jw_x_addr_missing", "min_name_sim", "addr_sim_harmonic", "source_is_s3", "tfidf_score", "tfidf_rank", "blocking_channel_count"]


@_query(f"""{O.base(O.PARTS, O.ALL)} {O.FREQUENCY}, x as (select *, {O.jw('an', 'bn')} jw, {O.jw('aa', 'ba')} aw, {O.jaccard(O.words('aa'), O.words('ba'))} aj, {O.jaccard(O.words('an'), O.words('bn'))} nj, string_split(an, ' ') ta, string_split(bn, ' ') tb from f)
select s1_id, cand_id, (an <> '' and ta[-1] = tb[-1])::int::double name_last_tok, (ab <> '' and split_part(ab, ' ', 1) = split_part(bb, ' ', 1))::int::double translit_first_tok,
abs(len(list_filter(ta, lambda w: w <> '')) - len(list_filter(tb, lambda w: w <> '')))::double name_token_diff, round(jw * aj, 6) name_addr_prod, round((jw + aw) / 2, 6) name_addr_sum,
round(case when ap <> '' and ap = bp then jw else 0.0 end, 6) name_postal_prod, round(case when ba = '' then jw else 0.0 end, 6) name_jw_x_addr_missing, round(least(jw, nj), 6) min_name_sim,
round(2 * aw * aj / (aw + aj + 1e-6), 6) addr_sim_harmonic, (cand_id like 'S3%')::int::double source_is_s3, 0.0::double tfidf_score, 99.0::double tfidf_rank, channel_count::double blocking_channel_count from x""")
def pair_products(spark, sf_dir):
    """Features made of other features, and the flags that no other query has."""
    return pair_features(spark, sf_dir).select("s1_id", "cand_id", *[F.round(n, 6).alias(n) for n in _PRODUCTS])


@_query()
def pair_features(spark, sf_dir):
    """All 56 features of the scored candidates."""
    s1, targets = _parts(spark, sf_dir)
    return features.features(features.top_pairs(blocking.candidates(s1, targets)), s1, targets)


@_query(f"{O.base(O.PARTS, O.ALL)}, {O._P}, {O.TRUTH}, l as (select pool.*, truth.s1_id is not null label from pool left join truth using (s1_id, cand_id)), x as (select *, row_number() over (partition by country, s1_id, label order by channel_count desc, cand_id) k from l) select s1_id, cand_id, channel_count, label::int label from x where label or k <= 5")
def hard_negatives(spark, sf_dir):
    return features.training_pairs(_pool(spark, sf_dir), adapters.part_truth(spark, sf_dir)).select("s1_id", "cand_id", "channel_count", "label")


def _simple_scores(spark, sf_dir) -> DataFrame:
    """A score without a learned model: name and address word similarity in equal parts."""
    f = features.native_features()
    return _pairs(spark, sf_dir).select("country", "s1_id", "cand_id", F.round((f["name_jaccard"] + f["addr_jaccard"]) / 2, 6).alias("score"))


_SCORED_SQL = f"{O.base(O.PARTS, O.ALL)} {O.FREQUENCY}, scored as (select country, s1_id, cand_id, round(({O.jaccard(O.words('an'), O.words('bn'))} + {O.jaccard(O.words('aa'), O.words('ba'))}) / 2, 6) score from f)"


@_query(f"{_SCORED_SQL} select country, s1_id, cand_id, round(case when country = 'France' then 0.3 * s + 0.7 * s * s else 0.7 * s + 0.3 * s * s end, 8) score from (select *, round(score, 3) s from scored)")
def blend_scores(spark, sf_dir):
    s = _simple_scores(spark, sf_dir)
    p = F.round("score", 3)
    return s.withColumn("score", F.round(model.blend(p, p * p, 0.7, F.col("country")), 8))


@_query(f"{_SCORED_SQL} select country, s1_id, cand_id, score from (select *, row_number() over (partition by country, s1_id order by score desc, s1_id, cand_id) i, row_number() over (partition by country, cand_id order by score desc, s1_id, cand_id) j from scored) where i = 1 and j = 1")
def match_mutual_best(spark, sf_dir):
    return matching.mutual_best(_simple_scores(spark, sf_dir))


@_query()
def match_greedy(spark, sf_dir):
    return matching.greedy_match(matching.above_threshold(_simple_scores(spark, sf_dir), {"US": 0.5}, 0.45))


@_query(f"""{_SCORED_SQL}, {O._P}, {O.TRUTH}, m as (select s1_id, cand_id from (select *, row_number() over (partition by country, s1_id order by score desc, s1_id, cand_id) i, row_number() over (partition by country, cand_id order by score desc, s1_id, cand_id) j from scored) where i = 1 and j = 1),
e as (select id s1_id from p where id like 'S1-%'), c as (select e.s1_id, count(distinct m.cand_id) np, count(distinct truth.cand_id) nt, count(distinct case when m.cand_id = truth.cand_id then m.cand_id end) nh from e left join m using (s1_id) left join truth using (s1_id) group by 1)
select count(*) n_entities, sum((np = 0)::int)::bigint n_empty, round(avg(case when np = 0 and nt = 0 then 1.0 when nh = 0 then 0.0 else 1.25 * (nh / np) * (nh / nt) / (0.25 * nh / np + nh / nt) end), 6) macro_f05 from c""")
def macro_f05(spark, sf_dir):
    entities = _parts(spark, sf_dir)[0].select(F.col("entity_id").alias("s1_id"))
    return metrics.macro_f05(matching.mutual_best(_simple_scores(spark, sf_dir)), adapters.part_truth(spark, sf_dir), entities)


@_query("""with t as (select c_custkey, '[''S2-' || c_custkey || ''', ''S3-' || c_nationkey || ''', None, ]' ids from customer)
select 'S1-' || c_custkey s1_id, unnest(['S2-' || c_custkey, 'S3-' || c_nationkey]) cand_id from t join customer using (c_custkey)""")
def parse_gt(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("['S2-"), F.col("c_custkey").cast("string"), F.lit("', 'S3-"), F.col("c_nationkey").cast("string"), F.lit("', None, ]"))
    return metrics.parse_truth(c.select(F.concat(F.lit(" S1-"), F.col("c_custkey").cast("string")).alias("source1_entity_id"), text.alias("matched_entity_ids")))


@_query(f"with {O.PARTS} select entity_id, country, row_number() over (partition by country order by left(md5('42:' || entity_id), 15), entity_id) <= least(floor(count(*) over (partition by country) * 0.15::double), 25000) is_validation from rec where entity_id like 'S1-%'")
def stratified_split(spark, sf_dir):
    return metrics.stratified_split(_parts(spark, sf_dir)[0]).select("entity_id", "country", "is_validation")


@_query(f"with {O.PARTS}, {O._P}, {O.TRUTH}, l as (select s1_id, string_agg(cand_id, ',' order by cand_id) ids from truth group by 1) select entity_id source1_entity_id, coalesce(ids, '') matched_entity_ids from rec left join l on s1_id = entity_id where entity_id like 'S1-%'")
def export_lists(spark, sf_dir):
    s1 = adapters._split_sources(adapters.part_records(spark, sf_dir))[0]
    return tables.export_lists(adapters.part_truth(spark, sf_dir), s1)


@_query("""with s as (select 'S1-' || s_suppkey id, s_suppkey k, s_nationkey n from supplier),
l as (select id s1_id, case when n = 1 then ['S2-1', 'S2-1'] when n = 2 then ['S1-7'] when n = 3 then ['X-1'] else ['S3-' || k] end ids from s where n <> 4 union all select id, ['S2-9'] from s where n = 5 union all select 'S1-none', ['S2-9'] from region where r_regionkey = 0)
select * from (select 'duplicate_row' rule, count(*) n from (select s1_id from l group by 1 having count(*) > 1) union all select 'duplicate_in_list', count(*) from l where len(list_distinct(ids)) < len(ids)
union all select 'source1_id_in_list', count(*) from (select unnest(ids) i from l) where i like 'S1-%' union all select 'bad_prefix', count(*) from (select unnest(ids) i from l) where not regexp_matches(i, '^S[123]-')
union all select 'missing_row', count(*) from s where id not in (select s1_id from l) union all select 'extra_row', count(*) from l where s1_id not in (select id from s))""")
def validate_rules(spark, sf_dir):
    """Faults planted in lists made of suppliers, by nation."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("S1-"), F.col("s_suppkey").cast("string")).alias("s1_id"), "s_suppkey", F.col("s_nationkey").alias("n"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    ids = F.when(F.col("n") == 1, lit("S2-1", "S2-1")).when(F.col("n") == 2, lit("S1-7")).when(F.col("n") == 3, lit("X-1")).otherwise(F.array(F.concat(F.lit("S3-"), F.col("s_suppkey").cast("string"))))
    lists = s.where("n <> 4").select("s1_id", ids.alias("ids")).unionByName(s.where("n = 5").select("s1_id", lit("S2-9").alias("ids")))
    lists = lists.unionByName(spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey = 0").select(F.lit("S1-none").alias("s1_id"), lit("S2-9").alias("ids")))
    return validate.validate_lists(lists, s.select(F.col("s1_id").alias("entity_id"))).select("rule", "n")


_TFIDF_SQL = """, w as (select country, entity_id id, entity_id like 'S1-%' s1, ' ' || unnest(string_split(name_norm, ' ')) || ' ' t from norm where name_norm <> ''),
g as (select country, id, s1, case when length(t) <= n then t else t[i : i + n - 1] end gram from w, (select unnest([3, 4, 5]) n) s, unnest(range(1, greatest(length(t) - n + 1, 1) + 1)) r(i)),
tf as (select country, id, s1, gram, 1 + ln(count(*)) tf from g group by all), tot as (select country, count(*) n from norm group by 1),
df as (select country, gram, ln((1 + any_value(n)) / (1 + count(*))) + 1 idf from tf join tot using (country) group by country, gram),
v as (select country, id, s1, gram, tf * idf w from tf join df using (country, gram)), u as (select *, w / sqrt(sum(w * w) over (partition by id)) x from v),
c as (select a.country, a.id s1_id, b.id cand_id, round(sum(a.x * b.x), 6) cosine from u a join u b using (country, gram) where a.s1 and not b.s1 group by all)
select country, s1_id, cand_id, cosine from c where cosine >= 0.25 qualify row_number() over (partition by country, s1_id order by cosine desc, cand_id) <= 15"""


@_query(O.base(O.DOCUMENTS) + _TFIDF_SQL)
def tfidf_topk(spark, sf_dir):
    found = blocking.tfidf_pairs(*adapters._split_sources(_documents(spark, sf_dir)))
    return found.select("country", "s1_id", "cand_id", "cosine")


@_query()
def train_predict(spark, sf_dir):
    """Both ensembles trained on the training records' hard pairs, and the blended scores of all scored candidates."""
    from ravelin.plans.linkage import train_and_score

    return train_and_score(spark, sf_dir).select("country", "s1_id", "cand_id", F.round("score", 6).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _made.items() if sql}

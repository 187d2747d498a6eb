"""Blocking, similarity, matching, metrics, validation, sources."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ravelin import queries
from ravelin.functions import similarity as S
from ravelin.functions.normalize import normalize
from ravelin.operators import blocking, features, matching, metrics, model, validate
from ravelin.schema import RECORD
from ravelin.sources import tables
from tests.conftest import SF


@pytest.mark.parametrize("name", ["normalize_names", "state_code", "block_exact_name", "candidates_topk", "sim_jaro_winkler", "match_mutual_best", "parse_gt", "validate_rules", "export_lists", "stratified_split", "pair_products"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "part", "customer", "supplier", "region", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    shown = lambda rows: sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert shown(df.select(cols).collect()) == shown(con.sql(queries.oracle_sql()[name]).select(", ".join(cols)).fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries.queries()) > 35


def test_caps_count_targets_and_repeats(spark):
    rows = [("S1-1", "acme works", "", "US")] + [(f"S2-{i}", "acme works", "", "US") for i in range(250)]
    s1, targets = (normalize(spark.createDataFrame([r for r in rows if r[0].startswith(p)], RECORD)) for p in ("S1", "S2"))
    assert blocking.hits(s1, targets, ["1"]).count() == 250
    more = targets.unionByName(normalize(spark.createDataFrame([("S3-1", "acme works", "", "US")], RECORD)))
    assert blocking.hits(s1, more, ["1"]).count() == 0
    words = [("S1-1", "a", "lima lima", "US")] + [(f"S2-{i}", "a", "lima lima" if i < 37 else "lima", "US") for i in range(38)]
    s1, targets = (normalize(spark.createDataFrame([r for r in words if r[0].startswith(p)], RECORD)) for p in ("S1", "S2"))
    assert blocking.hits(s1, targets, ["25"]).distinct().count() == 38
    again = targets.unionByName(normalize(spark.createDataFrame([("S3-1", "a", "lima", "US")], RECORD)))
    assert blocking.hits(s1, again, ["25"]).count() == 0


def test_channel_count_is_a_maximum_and_top_k_breaks_ties(spark):
    found = spark.createDataFrame([("US", c, "S1-1", "S2-1") for c in ("1", "2", "25", "25")] + [("US", "24", "S1-1", "S2-2"), ("US", "39", "S1-1", "S2-2"), ("US", "1", "S1-1", "S2-3")], "country string, channel string, s1_id string, cand_id string")
    counted = blocking.channel_counts(found)
    assert {r.cand_id: r.channel_count for r in counted.collect()} == {"S2-1": 2, "S2-2": 3, "S2-3": 1}
    tied = spark.createDataFrame([("US", "S1-1", f"S2-{i}", 1) for i in (3, 1, 2)], "country string, s1_id string, cand_id string, channel_count bigint")
    assert sorted(r.cand_id for r in blocking.top_candidates(tied, 2).collect()) == ["S2-1", "S2-2"]


def test_similarity_against_known_values_and_duckdb():
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611111)
    assert S.indel_ratio("abc", "abd") == pytest.approx(2 / 3)
    assert S.token_sort_of("b a", "a b") == 1 and S.token_set_of("a b c", "a b") == 1
    assert S.token_set_of("x", "y") == 0 and S.lcs_ratio_of("abcd", "bc") == 0.5 and S.lcs_ratio_of("", "x") == 0
    rng = random.Random(0)
    pairs = [tuple("".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(2)) for _ in range(300)]
    con = duckdb.connect()
    for a, b in pairs:
        want = con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert S.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-9), (a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, c in enumerate(a):
            for j, d in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        assert S.common_subsequence(a, b) == table[-1][-1]
    long = "x" * 81
    assert S.lcs_ratio_of(long + "ab", long + "ba") == pytest.approx(1 - 2 / 83)


def test_features_are_bounded_and_complete(spark):
    df = queries.pair_features(spark, SF).cache()
    assert df.columns[3:] == features.FEATURES and len(features.FEATURES) == 56
    low = df.agg(*[F.min(c).alias(c) for c in features.FEATURES]).first()
    high = df.agg(*[F.max(c).alias(c) for c in features.FEATURES]).first()
    counts = {"name_char_diff", "name_token_diff", "num_candidates", "tfidf_rank", "blocking_channel_count", "postal_log_freq", "city_log_freq", "name_log_freq_s1", "name_log_freq_cand"}
    for c in features.FEATURES:
        assert low[c] >= -1 and (c in counts or high[c] <= 1), c


def slow_match(pairs, cap, gap):
    held, taken, top, out = {}, set(), {}, []
    for s, c, p in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        top.setdefault(s, p)
        if c in taken or held.get(s, 0) >= cap or gap is not None and held.get(s, 0) >= 2 and p < top[s] - gap:
            continue
        held[s] = held.get(s, 0) + 1
        taken.add(c)
        out.append((s, c))
    return sorted(out)


def test_greedy_matching(spark):
    example = [("x", "t1", 0.95), ("y", "t1", 0.93), ("x", "t2", 0.90), ("x", "t3", 0.80), ("x", "t4", 0.78), ("y", "t4", 0.70)]
    frame = lambda rows: spark.createDataFrame([("US", *r) for r in rows], "country string, s1_id string, cand_id string, score double")
    got = lambda df, **k: sorted((r.s1_id, r.cand_id) for r in matching.greedy_match(df, **k).collect())
    assert got(frame(example)) == [("x", "t1"), ("x", "t2"), ("x", "t3"), ("y", "t4")]
    assert got(frame(example), gap=None) == [("x", "t1"), ("x", "t2"), ("x", "t3"), ("x", "t4")]
    rng = random.Random(1)
    for cap, gap in ((2, 0.16), (8, None)):
        pairs = [(f"s{i}", f"c{j}", round(rng.random(), 1)) for i in range(9) for j in range(14) if rng.random() < 0.5]
        assert got(frame(pairs), cap=cap, gap=gap) == slow_match(pairs, cap, gap)
    assert got(frame([("a", "b", 0.3)]), singleton=0.4) == [] and got(frame(example[:0])) == []
    odd = spark.createDataFrame([("US", "a", "b", 0.5), ("US", "a", "b", 0.7), ("US", None, "b", 0.9), ("US", "a", "c", None)], "country string, s1_id string, cand_id string, score double")
    assert [tuple(r) for r in matching.greedy_match(odd).collect()] == [("US", "a", "b", 0.7)]


def test_greedy_matching_of_ties_and_chains(spark):
    frame = lambda rows: spark.createDataFrame([("US", *r) for r in rows], "country string, s1_id string, cand_id string, score double")
    got = lambda df, **k: sorted((r.s1_id, r.cand_id) for r in matching.greedy_match(df, **k).collect())
    ties = [(f"s{i:03}", f"c{j:03}", 0.9) for i in range(60) for j in range(400)]
    assert got(frame(ties)) == slow_match(ties, 8, 0.16)
    chains = [(f"s{i:03}", f"c{i * 5 + j:04}", 0.7) for i in range(120) for j in range(30)]
    assert got(frame(chains), rounds=3) == slow_match(chains, 8, 0.16)
    rng = random.Random(5)
    mixed = [(f"s{i}", f"c{j}", round(rng.random(), 1)) for i in range(40) for j in range(60) if rng.random() < 0.3]
    for rounds in (0, 1, 4):
        assert got(frame(mixed), rounds=rounds, cap=3) == slow_match(mixed, 3, 0.16)


@pytest.mark.parametrize("truth, predicted, want", [("", "", 1), ("", "a", 0), ("a", "", 0), ("ac", "abc", 0.7143), ("abc", "a", 0.7143), ("abcd", "a", 0.625), ("a", "b", 0)])
def test_entity_score(spark, truth, predicted, want):
    links = lambda x: spark.createDataFrame([("s", c) for c in x], "s1_id string, cand_id string")
    entities = spark.createDataFrame([("s",)], "s1_id string")
    assert metrics.entity_f05(links(predicted), links(truth), entities).first().f05 == pytest.approx(want, abs=1e-4)


def test_split_is_stratified_and_repeatable(spark):
    df = spark.createDataFrame([(f"S1-{i}", "US" if i % 3 else "India") for i in range(3000)], "entity_id string, country string")
    a, b = (metrics.stratified_split(x).where("is_validation") for x in (df, df.repartition(7)))
    assert {r.country: r["count"] for r in a.groupBy("country").count().collect()} == {"US": 300, "India": 150}
    assert a.exceptAll(b).count() == 0
    assert metrics.stratified_split(df, most=10).where("is_validation").count() == 20


def test_blend_routes_france(spark):
    df = spark.createDataFrame([("US", 1.0, 0.0), ("France", 1.0, 0.0)], "country string, p1 double, p2 double")
    got = {r.country: r.s for r in df.select("country", model.blend(F.col("p1"), F.col("p2"), 0.7, F.col("country")).alias("s")).collect()}
    assert got == {"US": pytest.approx(0.7), "France": pytest.approx(0.3)}
    assert model.Ensemble.from_json(model.Ensemble(0.5).to_json()).alpha == 0.5


def test_headers():
    assert validate.check_header(None, "matches") and validate.check_header("", "matches")
    assert "comma" in validate.check_header("source1_entity_id,matched_entity_ids", "matches")
    assert validate.check_header("a\tb", "matches")
    assert validate.check_header("Source1_Entity_ID\tmatched_entity_ids\n", "matches") is None


def test_file_rules_and_round_trip(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    good = tmp_path / "good"
    tables.write_lists(spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-1")], "s1_id string, cand_id string"), s1, str(good))
    report = validate.validate_file(spark, str(good), "matches", s1, known).collect()
    assert sum(r.n for r in report) == 0 and len(report) == 8
    lists = {r.s1_id: r["ids"] for r in validate.lists_of(spark.read.text(str(good))).collect()}
    assert lists["S1-1"] == ["S2-1", "S3-1"] and lists["S1-2"] == []
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\tS1-9\nno tab here\nS1-7\tQ-1,S2-5\n\n")
    found = {r.rule: (r.n, r.examples) for r in validate.validate_file(spark, str(bad), "matches", s1, known).collect()}
    assert found == {"no_tab": (1, "no tab here"), "duplicate_row": (1, "S1-1"), "duplicate_in_list": (1, "S1-1"), "source1_id_in_list": (1, "S1-9"), "bad_prefix": (1, "Q-1"), "missing_row": (2, "S1-2, S1-3"), "extra_row": (1, "S1-7"), "unknown_id": (1, "S2-5")}
    assert validate.validate_file(spark, str(tmp_path / "none"), "matches", s1).first().examples == "the file is missing"
    a = spark.createDataFrame([("S1-1", ["S2-1", "S2-2"])], "s1_id string, ids array<string>")
    b = spark.createDataFrame([("S1-1", ["S2-1"])], "s1_id string, ids array<string>")
    r = validate.validate_subset(a, b).first()
    assert (r.severity, r.n, r.offenders, r.examples) == ("warning", 1, 1, "S1-1 S2-2")


def test_padded_and_empty_ids_and_late_headers_are_reported(spark, tmp_path, capsys):
    from ravelin.plans import validation

    (tmp_path / "test_source1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tUS\nS1-2\ta\tb\tUS\n")
    head = "source1_entity_id\tmatched_entity_ids\n"
    files = {"good": head + "S1-1\tS2-1,S3-1\nS1-2\t\n", "odd": head + "S1-1\tS2-1,, S2-2\nS1-2\t  \n", "late": "S1-1\tS2-1\n" + head + "S1-2\t\n", "more": head.replace("matched", "candidate") + "S1-1\tS2-1\nS1-2\t\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.tsv").write_text(text)
    run = lambda name, *more: validation.main(["-m", str(tmp_path / f"{name}.tsv"), "-t", str(tmp_path), *more])
    assert run("good") == 0 and run("odd") == 1 and run("late") == 1 and run("none") == 1
    told = capsys.readouterr().out
    assert "bad_prefix: 2: ,  S2-2" in told and "the header is not" in told and "the file is missing" in told
    assert run("good", "-c", str(tmp_path / "more.tsv")) == 0
    assert "warning" in capsys.readouterr().out


def test_curve_of_one_matching_equals_matchings_at_each_threshold(spark):
    rng = random.Random(6)
    rows = [("US", f"s{i}", f"c{j}", round(rng.random(), 2)) for i in range(12) for j in range(30) if rng.random() < 0.3]
    scored = spark.createDataFrame(rows, "country string, s1_id string, cand_id string, score double")
    truth = spark.createDataFrame([(s, c) for _, s, c, p in rows if p > 0.6 and s != "s3"], "s1_id string, cand_id string")
    entities = spark.createDataFrame([(f"s{i}",) for i in range(13)], "s1_id string")
    taus = [0.2, 0.55, 0.9, 1.5]
    got = dict(metrics.threshold_curve(scored, truth, entities, taus))
    for tau in taus:
        found = matching.greedy_match(matching.above_threshold(scored, {}, tau))
        assert got[tau] == pytest.approx(metrics.macro_f05(found, truth, entities).first().macro_f05, abs=1e-6)


def test_sources(spark, tmp_path):
    f = tmp_path / "test_source1.tsv"
    f.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" Ltd\t1 A St, B\tUS\nS1-2\tRagged\nS1-3\tMany\tx\tUS\textra\n')
    rows = tables.read_tsv(spark, str(f)).orderBy("entity_id").collect()
    assert [r.business_name for r in rows] == ['"Quoted" Ltd', "Ragged", "Many"] and rows[1].country is None
    first = tables.load_source(spark, str(f), str(tmp_path / "cache")).count()
    f.unlink()
    assert tables.load_source(spark, str(f), str(tmp_path / "cache")).count() == first == 3
    truth = spark.createDataFrame([("S1-1", "['S2-1', \"S3-2\"]"), ("S1-2", "[]"), ("S1-3", None), ("S1-4", "None")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, metrics.parse_truth(truth).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]


def test_cached_sources_follow_their_files(spark, tmp_path):
    f, head = tmp_path / "test_source1.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    load = lambda: sorted(r.name_norm for r in tables.load_source(spark, str(f), str(tmp_path / "cache")).collect())
    f.write_text(head + "S1-1\tOne\tx\tUS\n")
    assert load() == load() == ["one"]
    f.write_text(head + "S1-1\tOne\tx\tUS\nS1-2\tTwo\tx\tIndia\n")
    assert load() == ["one", "two"]


def test_all_steps_of_the_linkage(spark, tmp_path):
    from ravelin.plans import linkage, validation

    names = [f"{a}{b} {c}" for a in ("brook", "stone", "lark") for b in ("mere", "field", "wick", "ton") for c in ("bakery", "motors", "books", "dental", "paints")]
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    row = lambda i, k, name: f"S{k}-{i}\t{name}\t{i + 10} {name.split()[0]} Street, Austin, TX {78000 + i}\tUS\n"
    for kind in ("train", "test"):
        for k, shape in ((1, "{} Inc"), (2, "{}"), (3, "The {} Ltd")):
            (tmp_path / f"{kind}_source{k}.tsv").write_text(head + "".join(row(i, k, shape.format(n)) for i, n in enumerate(names)))
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t['S2-{i}', 'S3-{i}']\n" for i in range(len(names))))
    out = str(tmp_path / "out")
    linkage.run(spark, str(tmp_path), out, trees=3, depth=2)
    report = spark.read.parquet(f"{out}/validation").collect()
    assert report and sum(r.n for r in report if r.severity == "error") == 0
    found = {r.s1_id: set(r["ids"]) for r in validate.lists_of(spark.read.text(f"{out}/matching_results.tsv")).collect()}
    assert found.pop("source1_entity_id") == {"matched_entity_ids"}
    assert len(found) == len(names) and sum(found[f"S1-{i}"] == {f"S2-{i}", f"S3-{i}"} for i in range(len(names))) > 50
    assert spark.read.parquet(f"{out}/recall").count() > 0
    assert validation.main(["-m", f"{out}/matching_results.tsv", "-c", f"{out}/candidate_pairs.tsv", "-t", str(tmp_path)]) == 0


def test_normalizing_a_stream(spark, tmp_path):
    spark.createDataFrame([("S1-1", "Foo Ltd", "1 A St, B", "US")], RECORD).write.parquet(str(tmp_path / "in"))
    stream = normalize(spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("normalized").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("normalized").first().name_norm == "foo"


def test_tfidf_keeps_grams_that_most_records_have(spark):
    records = lambda side, n: spark.range(n).selectExpr("'X' country", f"concat('{side}-', id) entity_id", "'common' name_norm")
    got = blocking.tfidf_pairs(records("S1", 2), records("S2", 2001)).collect()
    assert len(got) == 30 and {r.cosine for r in got} == {1.0}

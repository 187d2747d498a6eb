"""Normalization and keys on literal rows, quirks included."""

import pytest
from pyspark.sql import functions as F

from ravelin.functions.normalize import deconstruct_url, normalize
from ravelin.operators import keys
from ravelin.schema import RECORD

NAMES = [
    ("Williams Flowers Inc", "williams flowers inc", "williams flowers", "flowers williams", "williams"),
    ("M/s. Sharma & Sons Pvt. Ltd.", "m s sharma and sons pvt ltd", "m s sharma and sons", "m s sharma sons", "m"),
    ("https://www.foo-bar.com/x", "foo bar", "foo bar", "bar foo", "foo"),
    ("urbanconstruction.com", "urbanconstruction", "urbanconstruction", "urbanconstruction", "urbanconstruction"),
    ("S.A.R.L. Dupont", "s a r l dupont", "s a r l dupont", "dupont l r s", "s"),
    ("Café Ônix Ltd", "cafe onix ltd", "cafe onix", "cafe onix", "cafe"),
    ("Limited", "limited", "", "", ""),
    ("O'Brien-Smith LLC", "obrien smith llc", "obrien smith", "obrien smith", "obrien"),
    (None, "", "", "", ""),
    ("Straße Œuvre", "strasse oeuvre", "strasse oeuvre", "oeuvre strasse", "strasse"),
    ("राम मंदिर", "rama mamdira", "rama mamdira", "mamdira rama", "rama"),
    ("தமிழ்", "tamizh", "tamizh", "tamizh", "tamizh"),
]
ADDRESSES = [
    ("123 Main St, Springfield, IL 62704", "US", "123 main street, springfield, il 62704", "62704", "springfield", "123", 0),
    ("45 Ocean Dr, Miami, FL 33139", "US", "45 ocean drive, miami, floor 33139", "33139", "miami", "45", 0),
    ("Shop 4, Near SBI ATM MG Road, Pune 411001", "India", "shop 4, , pune 411001", "411001", "near sbi atm mg road", "", 0),
    ("12 Rue de la Paix, 75002 Paris", "France", "12 rue de la paix, 75002 paris", "75002", "paris", "12", 0),
    ("12345 Elm St, Dallas, TX 75201", "US", "12345 elm street, dallas, tx 75201", "12345", "dallas", "12345", 0),
    ("7 Hill Rd, NY, 10001", "US", "7 hill road, ny, 10001", "10001", "", "7", 0),
    ("B-2/74 Sector 5, Noida, UP 201301", "India", "b 2 74 sector 5, noida, up 201301", "201301", "noida", "", 0),
    ("N/A", "US", "", "", "", "", 1),
    (" n/a ", "US", "n a", "", "", "", 0),
    (None, None, "", "", "", "", 1),
    ("Plot 0110001, x", "Peru", "plot 0110001, x", "", "", "", 0),
]


def test_names(spark):
    df = spark.createDataFrame([(f"S1-{i}", n[0], None, "US") for i, n in enumerate(NAMES)], RECORD)
    got = {r.entity_id: r for r in normalize(df).collect()}
    for i, (_, blocking, norm, tokens, first) in enumerate(NAMES):
        r = got[f"S1-{i}"]
        assert (r.name_blocking, r.name_norm, r.name_sorted_tokens, r.name_first_token) == (blocking, norm, tokens, first)


def test_addresses(spark):
    df = spark.createDataFrame([(f"S1-{i}", None, a[0], a[1]) for i, a in enumerate(ADDRESSES)], RECORD)
    got = {r.entity_id: r for r in normalize(df).collect()}
    for i, (_, _, norm, postal, city, street, missing) in enumerate(ADDRESSES):
        r = got[f"S1-{i}"]
        assert (r.addr_norm, r.postal_code, r.postal_prefix_3, r.city, r.street_number, r.addr_missing) == (norm, postal, postal[:3], city, street, missing)


def test_missing_country_column_and_empty_table(spark):
    df = spark.createDataFrame([("S1-1", "a", "b")], "entity_id string, business_name string, business_address string")
    assert normalize(df).first().country == ""
    assert normalize(df.limit(0)).count() == 0


def test_url(spark):
    rows = [("http://a.b-c.org/x?y", "a b c"), ("plain name", "plain name"), ("WWW.Foo.IN", "Foo")]
    got = spark.createDataFrame(rows, "u string, want string").select(deconstruct_url(F.col("u")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_no_python_in_the_plan(spark):
    df = keys.key_table(normalize(spark.createDataFrame([], RECORD)))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_keys(spark):
    rows = [("S2-1", "Dr Rao Tech Services Pvt Ltd", "12/A, B-2/74 MG Road, Bangalore, Karnataka 560001", "India"), ("S2-2", "In Place", "9 Oak Ave, Reno, NV 89501", "US"), ("S2-3", "x", "007 near 12 main street", "France")]
    norm = normalize(spark.createDataFrame(rows, RECORD))
    r = {x.entity_id: x for x in keys.with_keys(norm).collect()}
    assert (r["S2-1"].state_code, r["S2-1"].city, r["S2-1"].city_canon, r["S2-1"].postal_5) == ("KA", "bangalore", "bengaluru", "56000")
    assert (r["S2-1"].name_title_clean, r["S2-1"].name_tag_clean, r["S2-1"].name_clean) == ("rao tech services pvt ltd", "rao", "drrao")
    assert (r["S2-2"].state_code, r["S2-2"].street_num_clean, r["S2-2"].addr_feature_word) == ("NV", "9", "oak")
    assert r["S2-3"].street_num_clean == "7"
    k = {}
    for x in keys.key_table(norm).collect():
        k.setdefault((x.entity_id, x.channel), []).append(x.key.replace(keys.SEPARATOR, "|"))
    assert set(k["S2-1", "36"]) == {"2/74"}
    assert "bengaluru|b-2-74" in k["S2-1", "37"] and "KA|b-2-74" in k["S2-1", "38"]
    assert "bangalore|560001" not in k["S2-1", "27"]
    assert ("S2-3", "1") not in k


def test_building_code_has_no_word_boundary(spark):
    got = spark.createDataFrame([("123 main street",)], "a string").select(keys._all(F.col("a"), keys.C.BUILDING_CODE).alias("x")).first().x
    assert got == ["123 mai"]


def test_unknown_channel(spark):
    with pytest.raises(ValueError):
        keys.key_table(normalize(spark.createDataFrame([], RECORD)), ["99"])

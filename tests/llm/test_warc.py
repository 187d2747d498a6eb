"""WARC: round trips, predicates, skipped payloads, foreign files."""

import gzip
import hashlib
import io

import duckdb
import pytest

from ravelin.llm import queries, warc
from ravelin.scratch import new_path
from tests.conftest import SF


def sha(x):
    return hashlib.sha1(x).hexdigest()


def test_members_are_plain_gzip_and_headers_parse():
    raw = warc.record("urn:page:1", "response", "http://x/ü", "2024-01-01T00:00:00Z", b"abc\r\n\r\nd", warc.sha1_digest(sha(b"abc")), 8)
    member = warc.gzip_member(raw)
    assert gzip.decompress(member) == raw and warc._member_head(member)[1] == len(member)
    head = warc.parse_head(raw)
    assert warc.header_columns(head.fields) | {"date": ""} == {"record_id": "urn:page:1", "record_type": "response", "target_uri": "http://x/ü", "date": "", "refers_to": None, "payload_digest": sha(b"abc")}
    assert warc.digest_hex("sha1:" + sha(b"q").upper()) == sha(b"q") and warc.digest_hex("md5:zz") is None


@pytest.mark.parametrize("form", ["plain", "sl", "gzip", "mixed"])
@pytest.mark.parametrize("payloads", [True, False])
def test_reading_skips_what_is_not_wanted(form, payloads):
    records = [warc.record(f"r{i}", "response" if i % 2 else "revisit", None, "d", (b"x%d" % i) * (1 + i * 9000), "sha1:", i) for i in range(6)]
    coded = [{"plain": bytes, "sl": warc.gzip_member, "gzip": gzip.compress}[form if form != "mixed" else ("sl", "gzip")[i % 2]](r) for i, r in enumerate(records)]
    got = list(warc.read_records(warc.Stream(io.BytesIO(b"".join(coded)), 100), lambda c: c["record_id"] in ("r1", "r4", "r5"), payloads))
    assert [c["record_id"] for _, c, _ in got] == ["r1", "r4", "r5"]
    assert [warc.split_http(b)[0] for _, _, b in got] == [1, 4, 5]
    if payloads:
        assert [warc.split_http(b)[1] for _, _, b in got] == [b"x1" * 9001, b"", b"x5" * 45001]
    elif form in ("plain", "sl"):
        assert max(len(b) for _, _, b in got) <= 1 << 12


@pytest.mark.parametrize("form", ["plain", "sl", "gzip"])
def test_long_http_headers_are_read_to_their_end(form):
    noise = "".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(400)).encode()
    body = b"HTTP/1.1 200 OK\r\nX-Long: " + noise + b"\r\nContent-Length: 100000\r\n\r\n" + b"x" * 100_000
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    coded = {"plain": bytes, "sl": warc.gzip_member, "gzip": gzip.compress}[form](raw)
    (got,) = warc.read_records(warc.Stream(io.BytesIO(coded), 100), lambda c: True, False)
    assert warc.split_http(got[2])[0] == 100_000 and len(got[2]) < 110_000


def test_broken_member_is_an_error():
    member = bytearray(warc.gzip_member(warc.record("a", "response", None, "d", b"x" * 500, "sha1:", 500)))
    member[-6] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(warc.read_records(warc.Stream(io.BytesIO(bytes(member))), lambda c: True, True))


def test_predicates_are_pushed_and_archives_round_trip(spark):
    warc.register(spark)
    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c x", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (9, "again", big), (None, "n", "null id")]
    path = new_path(spark, "warc")
    warc.archive_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string"), path)
    df = spark.read.format(warc.FORMAT).load(path)
    got = sorted((r.record_id, r.record_type, r.refers_to, bytes(r.payload).decode(), r.http_length) for r in df.collect())
    want = [("urn:page:1", "revisit", "urn:page:9", "", 1200), ("urn:page:2", "revisit", "urn:page:9", "", 1200), *[("urn:page:9", "response", None, big, 1200)] * 2, *((f"urn:page:{i}", "response", None, t, len(t)) for i, t in [(3, "small"), (4, "small"), (5, ""), (6, "")]), ("urn:page:", "response", None, "null id", 7)]
    assert got == sorted(want)
    one = df.where("record_type = 'revisit' and record_id in ('urn:page:1', 'urn:page:3') and target_uri like 'http%'").select("record_id", "http_length")
    assert one.collect() == [("urn:page:1", 1200)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
    without = spark.read.format(warc.FORMAT).option("payload", "false").load(path).where("http_length = 1200")
    assert without.count() == 4 and without.where("payload is not null").count() == 0


def test_no_payload_is_shuffled(spark, monkeypatch):
    """Repeated digests are broadcast; beyond the bound they are joined, with the same result."""
    rows = [(i, "u", "é" * (600 + i % 3)) for i in range(9)] + [(20, "u", "alone " * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for most in (warc._SENT, 0):
        monkeypatch.setattr(warc, "_SENT", most)
        table = warc.records(*warc.hashed(df, "page_id", "url", "html", 1000), "d")
        if most:
            assert "hashpartitioning" not in table._jdf.queryExecution().executedPlan().toString()
        made.append(sorted(map(tuple, table.collect()), key=str))
    assert made[0] == made[1] and sum(r[1] == "revisit" for r in made[0]) == 6


def test_empty_archive(spark):
    warc.register(spark)
    path = new_path(spark, "warc")
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert spark.read.format(warc.FORMAT).load(path).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op4_warc"]).fetchall())
    assert sorted(tuple(r) for r in queries.op4_warc(spark, SF).collect()) == want

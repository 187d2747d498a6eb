"""SimHash, decontamination and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from ravelin.llm import decontam, sharding, simhash
from ravelin.operators import components

ODD = ["", None, " \n\t ", "one", "One two", "a b c", "a b c", "Ünï code Straße ÀB", "x" * 5000, "w " * 3000, "a b c d e f g h i j k l", "\x1c a\x85b \x00c"]


def docs_of(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang=None, n_words=None, id="clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int, id string")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fps, radius=2):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_documents(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts = [*ODD, *base, *(t + " x" for t in base[:20]), *base[:20]]
    got = {r.id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps)


@pytest.mark.parametrize("tile", [4, 1024])
def test_simhash_hot_key_is_dealt_and_complete(spark, tile):
    rng = random.Random(2)
    seed = rng.getrandbits(64)
    fps = sorted({seed ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    found = {r.node: r.root for r in components.connected_components(simhash.near_links(df, tile=tile)).collect()}
    slow = slow_components(fps)
    groups = {}
    for i, s in enumerate(slow):
        groups.setdefault(s, set()).add(signed[i])
    for g in groups.values():
        assert {found.get(x, x) for x in g} == {min(g)}


def test_simhash_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "q r s t"), (7, "q r s t"), (None, "alone here now")], "doc_id long, text string")
    assert sorted((str(r.id), str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == [("7", "7"), ("None", "7"), ("None", "None")]


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def slow_contamination(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for i, item in items:
            x = words(item)
            n = min(len(x), window)
            for q in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[q : q + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 400])
def test_contamination(spark, part_bytes):
    rng = random.Random(3)
    vocabulary = "a b c d é zz".split()
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([2, 5, 9, 10, 11, 25]))) for i in range(12)] + [(90, None), (91, ""), (92, "ß9"), (93, "a " * 30), (2, "Repeated ID x")]
    texts = [*ODD, *(line(rng.randint(0, 80)) for _ in range(40)), *(line(5) + "! " + (items[i % 12][1] or "").upper() + ", " + line(4) for i in range(24)), "a " * 500]
    docs = docs_of(spark, texts).drop("n_words")
    frame = spark.createDataFrame([Row(item_id=i, text=t, lang="x") for i, t in items], "item_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, sum(h.stop - h.start for h in r.hits), r["items"]) for r in decontam.find_contamination(docs, frame, part_bytes=part_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == slow_contamination(texts, items)


def test_contamination_empty_sides_and_clash(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontam.find_contamination(docs_of(spark, ["a b"]).drop("n_words"), items).first()
    assert (got.n_words, got.hits, got["items"]) == (2, [], [])
    with pytest.raises(ValueError, match="n_words"):
        decontam.find_contamination(docs_of(spark, ["a"]), items)


def test_sharding_law(spark):
    df = spark.createDataFrame([(i if i % 50 else None, "v") for i in range(3000)], "doc_id long, x string")
    rows = sharding.with_slots(sharding.shard_records(df, "doc_id", [1.0] * 7 + [2.0], grown_weight=1.0).drop("slot"), "shard", "doc_id", rows_per_task=100).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    sizes = [0] * 8
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
        sizes[s] = len(slots)
    assert 500 < sizes[7] < 850 and max(sizes[:7]) < 450
    assert 250 < sum(r.grown_shard == 8 for r in rows) < 430
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.shard_records(df.limit(0), "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous("x", [])


def slow_shard(key, weights, seed=0):
    scores = []
    for i, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(key.encode(), xxhash.xxh64_intdigest(f"{seed}:{i}".encode(), 42))
        scores.append(-w / math.log(((h >> 11) + 0.5) / 2**53))
    return scores.index(max(scores))


def test_shards_by_brute_force_and_clashing_columns(spark):
    df = spark.createDataFrame([(i if i % 9 else None, "c", "a", "s", "n") for i in range(300)], "doc_id long, _cell string, _at string, _start string, _n string")
    rows = sharding.shard_records(df, "doc_id", [1.0, 2.0, 0.5], grown_weight=1.5).collect()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (slow_shard(key, [1.0, 2.0, 0.5]), slow_shard(key, [1.0, 2.0, 0.5, 1.5]))
        assert (r._cell, r._at, r._start, r._n) == ("c", "a", "s", "n")
    for c in ("shard", "grown_shard", "slot"):
        with pytest.raises(ValueError, match=c):
            sharding.shard_records(df.withColumnRenamed("_n", c), "doc_id", [1.0], grown_weight=1.0)


def test_queries_on_small_tables(spark):
    import duckdb

    from ravelin.llm import queries
    from tests.conftest import SF

    sql = queries.oracle_sql()["op8_decontamination"]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(con.sql(sql).fetchall())
    df = queries.op8_decontamination(spark, SF)
    assert sorted(tuple(r) for r in df.collect()) == want
    assert any(r[5] for r in want)
    rows = queries.op6_sharding(spark, SF).collect()
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)
    assert len(rows) == len(texts)
    assert hashlib.sha256(b"").hexdigest() == next(r[4] for r in want if not r[5])

"""The TF-IDF search: equal to brute force whatever the cells, and no join of grams."""

import random
import re
from collections import Counter
from math import log, sqrt

import pytest

from ravelin.operators import tfidf


def brute_force(rows, most=15, least=0.25):
    """``rows``: (country, id, is first, name)."""
    counts = {(c, i, s): Counter(g for w in n.split(" ") if w for g in tfidf.word_grams(w, (3, 4, 5))) for c, i, s, n in rows}
    total, df = Counter(r[0] for r in rows), Counter((k[0], g) for k, grams in counts.items() for g in grams)
    vectors = {}
    for k, grams in counts.items():
        w = {g: (1 + log(n)) * (log((1 + total[k[0]]) / (1 + df[k[0], g])) + 1) for g, n in grams.items()}
        norm = sqrt(sum(x * x for x in w.values()))
        vectors[k] = {g: x / norm for g, x in w.items()}
    out = []
    for (c, i, s), a in vectors.items():
        if s:
            found = [(-round(sum(x * b.get(g, 0) for g, x in a.items()), 6), j) for (d, j, t), b in vectors.items() if d == c and not t]
            out += [(c, i, j, -x, k) for k, (x, j) in enumerate(sorted(f for f in found if -f[0] >= least)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 100_000])
def test_equals_brute_force_with_copies_and_many_cells(spark, monkeypatch, block):
    rng = random.Random(3)
    words = ["the", "a", "of", "or", "thethe", "brookmere", "stonefield", "larkwick", "नई", "x" * 40, "bake", "bakery", "motors"]
    name = lambda: rng.choice(["same name", "name same", "", "a", " ".join(rng.choices(words, k=rng.randint(1, 6)))])
    rows = [(rng.choice("XXY"), f"S{1 + i % 3}-{i}", i % 3 == 0, name()) for i in range(400)] + [("Z", "S1-only", True, "the bakery")]
    monkeypatch.setattr(tfidf, "FIRST", block)
    monkeypatch.setattr(tfidf, "TARGETS", block)
    df = spark.createDataFrame(rows, "country string, entity_id string, first boolean, name_norm string")
    got = sorted((r.country, r.s1_id, r.cand_id, r.cosine, r["rank"]) for r in tfidf.tfidf_pairs(df.where("first"), df.where("not first")).collect())
    want = brute_force(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and len(got) > 1000
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_no_row_for_each_pair_and_gram(spark):
    from ravelin.operators import blocking

    copies = lambda side: spark.range(500).selectExpr("'X' country", f"concat('{side}-', id) entity_id", "'common name' name_norm")
    got = blocking.tfidf_pairs(copies("S1"), copies("S2"))
    assert not re.search(r"Join.*\bgram", got._jdf.queryExecution().toString())
    assert got.count() == 500 * 15 and {r.cand_id for r in got.select("cand_id").distinct().collect()} == set(sorted(f"S2-{i}" for i in range(500))[:15])


def test_no_targets_and_frequent_grams_left_out(spark):
    df = spark.createDataFrame([("X", "S1-1", "ab"), ("X", "S2-1", "ab"), ("X", "S2-2", "cd")], "country string, entity_id string, name_norm string")
    s1, t = df.where("entity_id like 'S1%'"), df.where("entity_id like 'S2%'")
    assert [(r.cand_id, r.cosine) for r in tfidf.tfidf_pairs(s1, t).collect()] == [("S2-1", 1.0)]
    assert tfidf.tfidf_pairs(s1, t, max_df=1).count() == 0
    assert tfidf.tfidf_pairs(s1, t.limit(0)).count() == 0

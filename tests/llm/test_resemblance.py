"""Near copies against all pairs by brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ravelin.llm import resemblance, simhash
from tests.conftest import SF
from tests.llm.test_pairs import lower


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_kept(texts):
    """The first text of each component of pairs with a similarity of 0.8 or more, and how many pairs of different sets there are."""
    sets, up, n = [shingles(t) for t in texts], list(range(len(texts))), 0

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                n += sets[i] != sets[j]
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if root(i) == i}, n


def test_near_copies_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    for length in (4, 5, 6, 12, 50, 100, 150, 300):
        for _ in range(4):
            base = rng.choices(words, k=length)
            texts.append(" ".join(base))
            for _ in range(5):  # chains around the least similarity
                base = base.copy()
                for _ in range(rng.randint(1, max(1, length // 35))):
                    base[rng.randrange(length)] = rng.choice(words)
                texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text"))
    want, n = slow_kept(texts)
    assert n > 20
    assert {r.doc_id for r in P.keep_one_of_each(spark, docs, SF).collect()} == want


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (7, long + " more"), (7, "an unrelated text of its own kind"), (7, "a third text that nobody else has"), (8, "same"), (8, "same")]
    got = P.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got)) == sorted([rows[0], *rows[2:5]])


def cluster(rng, n, words=60):
    """Copies of one text with more and more changed words: some are within the similarity of many others, some of none."""
    base = [f"v{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = base.copy()
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            copy[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("cell", [resemblance.CELL, 4000])
def test_hard_clusters_lose_no_link_and_make_few_rows(spark, cell):
    rng = random.Random(11)
    texts = [t for _ in range(3) for t in cluster(rng, 90)] + [None, "", "  ", "one two", "One two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in resemblance.near_copies(docs, "doc_id", cell=cell).collect():
        got.setdefault(r.component, []).append(r.id)
    want, _ = slow_kept([t or "" for t in texts])
    assert {min(x) for x in got.values()} == want and sum(map(len, got.values())) == len(texts)
    assert resemblance.near_copies(docs.limit(0), "doc_id").count() == 0


def test_links_span_and_are_no_more_than_needed():
    rng = random.Random(12)
    sets = [np.unique(simhash.shingle_hashes(np.frombuffer(b, np.uint8), *(np.array(x) for x in zip(*[m.span() for m in re.finditer(rb"\S+", b)])), 5)) for b in (t.encode() for t in cluster(rng, 200))]
    prints = np.array([simhash.fingerprint(s) for s in sets], np.uint64)
    links = resemblance.spanning_links(sets, prints, np.arange(200), np.zeros(200, np.int64), tile=16)
    two = resemblance.spanning_links(sets, prints, np.arange(200), (np.arange(200) % 2), tile=16)
    similar = lambda i, j: 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))
    every = [(i, j) for i in range(200) for j in range(i) if similar(i, j)]

    def components(pairs):
        forest = simhash.Forest(200)
        for i, j in pairs:
            forest.join(i, j)
        return [forest.root(i) for i in range(200)]

    assert components(links) == components(every) and components(two) == components([(i, j) for i, j in every if i % 2 != j % 2])
    assert len(links) == 200 - len(set(components(every))) < len(every) and all(similar(*x) for x in links + two)


def test_fingerprints_of_similar_sets_are_within_the_radius():
    """Sets at the least similarity, small and large: how many bits apart their fingerprints are."""
    rng = np.random.default_rng(13)
    for n in (5, 9, 45, 450):
        worst = []
        for _ in range(400):
            same, a, b = (rng.integers(0, 1 << 64, k, np.uint64) for k in (n - n // 9, n // 9, n // 9) ) if n > 5 else (rng.integers(0, 1 << 64, 4, np.uint64), rng.integers(0, 1 << 64, 1, np.uint64), np.zeros(0, np.uint64))
            x, y = (simhash.fingerprint(np.concatenate([same, o])) for o in (a, b))
            worst.append((x ^ y).bit_count())
        assert max(worst) <= resemblance.RADIUS and np.mean(worst) < 13

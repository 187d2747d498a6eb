"""Classifiers: gradients, held-out accuracy, and defined results for odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import features, langid, quality, queries, toxicity
from tests.conftest import SF

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 300000), (904, "12 34!"), (905, "word"), (905, "word"), (None, "word")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def test_backpropagation_through_time_equals_differences():
    rng = np.random.default_rng(0)
    model = langid.make_model(["a", "b", "c"], dtype=np.float64)
    w, s, y = rng.integers(97, 110, (5, langid.WINDOW)).astype(np.uint8), np.array([3, 24, 1, 7, 10]), np.array([0, 1, 2, 1, 0])
    _, grads = langid.loss_and_gradients(model, w, s, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        for _ in range(4):
            i = (int(w[1, 2]), 1) if p is model.embed else tuple(rng.integers(0, n) for n in p.shape)
            old, e = p[i], 1e-5
            p[i] = old + e
            up = langid.loss_and_gradients(model, w, s, y)[0]
            p[i] = old - e
            down = langid.loss_and_gradients(model, w, s, y)[0]
            p[i] = old
            assert abs((up - down) / 2 / e - g[i]) < 1e-7


def test_windows_cover_every_byte_of_every_word():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 5, 23, 24, 25, 70]))) for _ in range(rng.randint(0, 9))).encode() for _ in range(30)] + [b"", b"  "]
    for _, data, offsets in features.slices(features.binary(texts)):
        padded, size, doc, window, count = langid.windows_of(data, offsets)
        for i, t in enumerate(texts):
            got = sorted(padded[w, : size[w]].tobytes() for d, w, c in zip(doc, window, count, strict=True) for _ in range(c) if d == i)
            words = [x + b" " for x in t.split()]
            assert got == sorted(x[a : a + langid.WINDOW] for x in words for a in range(0, len(x), langid.WINDOW))


def test_language_query_and_odd_texts(spark):
    rows = queries.op10_language(spark, SF).collect()
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.9 * len(held)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, most=20)
    got = langid.predict(odd(spark), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (900, 901, 902, 904)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in got) and all(r.lang_pred in model.languages for r in got if r.doc_id in (903, 905, None))
    assert langid.predict(odd(spark).limit(0), model).count() == 0
    assert langid.predict(odd(spark), langid.fit(docs.limit(0))).count() == len(ODD)
    clash = langid.predict(odd(spark).selectExpr("*", "false as _letter", "1 as salt"), model).collect()
    assert [(r.lang_pred, r._letter, r.salt) for r in clash] == [(r.lang_pred, False, 1) for r in got]
    with pytest.raises(ValueError, match="score"):
        langid.predict(odd(spark).selectExpr("*", "1 as score"), model)


def test_non_negative_risk_learns_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (3000, 3)), rng.normal([4, 0, 0], 1, (3000, 3))
    unlabelled = np.concatenate([good[:1400], bad[:600]])
    prior = quality.estimate_prior(good[1400:], unlabelled)
    assert abs(prior - 0.7) < 0.12
    net = quality.fit_network(good[1400:], unlabelled, 0.7)
    assert (net.probabilities(good[:500]) >= 0.5).mean() > 0.9 and (net.probabilities(bad[600:]) < 0.5).mean() > 0.85
    alone = quality.fit_network(good[:0], unlabelled, 0.7)
    assert np.allclose(alone.probabilities(bad), 0.7)


def test_quality_query_and_odd_texts(spark):
    rows = {r.doc_id: r for r in queries.op7_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[i].predicted, q) for i, q in labels.items() if i in rows and rows[i].held_out]
    assert sum(p == q for p, q in held) >= 0.85 * len(held)
    docs, labelled = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    network = quality.fit(docs, labelled, features.remainder("doc_id", 5) != 0, most=100)
    got = quality.score(odd(spark), network).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd(spark).limit(0), network).count() == 0


def slow_tokens(text):
    """Words and how longer words begin, as bytes."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(features.LOWER[np.frombuffer(text, np.uint8)]))
    return [(w, 0) for w in words] + [(w[:n], n) for n in features.PREFIXES for w in words if len(w) > n]


def token_hash(token, n):
    """A token's hash, from a text that has it alone."""
    data = np.frombuffer(token + b"x" * (n > 0), np.uint8)
    w = features.Words(data, np.array([0, len(data)]), features.ALNUM)
    return int(w.prefixes(n)[0][0] if n else w.hashes()[0])


def test_probabilities_of_the_chain_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", "text").limit(25).unionByName(odd(spark).where("doc_id != 903"))
    place, known = {int(h): i for i, h in enumerate(chain.vocabulary.hashes)}, {}
    for r in toxicity.score(rows, chain).collect():
        x = np.zeros(len(chain.vocabulary))
        for t in slow_tokens((r.text or "").encode()):
            if t not in known:
                known[t] = token_hash(*t)
            if known[t] in place:
                x[place[known[t]]] += 1
        z = [min(math.log2(1 + v), 3) for v in x]
        for name, w in zip(chain.categories, chain.weights, strict=True):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, w[:-1], strict=True)) - w[-1]))
            assert abs(p - r["p_" + name]) < 1e-4
            z.append(p)


def test_links_use_earlier_categories_out_of_fold():
    rng = np.random.default_rng(9)
    bad, worse = rng.random(1500) < 0.4, rng.random(1500) < 0.3
    x = np.stack([bad, worse, rng.random(1500)], axis=1).astype(float)
    labels, fold = np.stack([bad, worse, bad & worse], axis=1).astype(float), np.arange(1500) % 5
    weights = toxicity.fit_links([x] * 6, [labels] * 6, fold)
    assert [len(w) for w in weights] == [4, 5, 6] and (weights[2][-3:-1] > 0).all()
    other = [x, *(np.where((fold == k)[:, None], 99, x) for k in range(5))]
    assert not np.allclose(toxicity.fit_links(other, [labels] * 6, fold)[1], weights[1])
    alone = toxicity.fit_links([x[:50]] * 6, [np.zeros((50, 1))] * 6, fold[:50])
    assert features.predict(alone[0], x[:50]).max() < 0.1
    assert len(toxicity.fit_links([x[:0]] * 6, [labels[:0]] * 6, fold[:0])) == 3


def test_toxicity_of_held_out_rows(spark):
    """Rows that the model has not seen; and what the chain gains over its last link alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = features.remainder("doc_id", 5) != 0
    wanted = {r.doc_id: bool(r.toxic) for r in labels.where(~seen).collect()}
    held = docs.join(labels.where(~seen).select("doc_id"), "doc_id")
    right = {}
    for name, categories in (("chain", toxicity.CHAIN), ("last link alone", toxicity.CHAIN[-1:])):
        rows = toxicity.score(held, toxicity.fit(docs, labels.where(seen), categories=categories)).collect()
        right[name] = sum((r.p_toxic >= queries.TOXIC) == wanted[r.doc_id] for r in rows) / len(rows)
    print("held-out accuracy of toxicity:", right, len(rows))
    assert right["chain"] >= 0.95


def test_samples_are_bounded_and_repeatable(spark):
    ids = spark.range(40_000).selectExpr("id % 3 as doc_id", "concat('text ', id % 7) as text")
    assert features.lowest(ids.select("doc_id"), F.xxhash64("doc_id"), 100).count() == 3
    assert features.lowest(spark.range(40_000), F.xxhash64("id"), 100).count() == 100
    for df in (ids, ids.repartition(5)):
        rows = features.sample(df, ids.selectExpr("doc_id", "1 as toxic"), ["toxic"], 100).collect()
        assert sorted((r.id, r.text) for r in rows) == sorted((i, min((f"text {j}" for j in range(7)), key=lambda t: spark.sql(f"select xxhash64('{t}') h").first().h)) for i in range(3))


def slow_style(text):
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, sizes, size = len(text), [len(w) for w in words], max(1, len(words))
    inside = {k: sum(t[c] for c in text) for k, t in features._CLASSES.items()}
    mean = sum(sizes) / size
    spread = max(0, sum(s * s for s in sizes) / size - mean**2) ** 0.5
    many = max(1, len(lines))
    last = bool(words) and bool(features._CLASSES["stop"][words[-1][-1]])
    shares = [v / max(1, n) for v in inside.values()]
    return [*shares, math.log1p(n) / 10, math.log1p(len(words)) / 10, min(mean, 40) / 10, min(spread, 40) / 10, len(set(words)) / size, sum(a == b for a, b in zip(words, words[1:])) / size, sum(s > 16 for s in sizes) / size, math.log1p(n / (1 + inside["line"])) / 10, last, sum(len(x) > 400 for x in lines) / many, sum(len(x) < 30 for x in lines) / many, (len(lines) - len(set(lines))) / many]


def test_quality_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).unionByName(odd(spark))
    rng = np.random.default_rng(2)
    net = quality.fit_network(rng.random((50, len(features.STYLE))), rng.random((60, len(features.STYLE))), 0.4, rounds=20)
    for r in quality.score(docs, net).collect():
        z = np.clip((np.array(slow_style((r.text or "").encode())) - net.mean) / net.scale, -8, 8)
        h = [math.tanh(sum(a * b for a, b in zip(z, net.w1[:, i], strict=True)) + net.b1[i]) for i in range(quality.HIDDEN)]
        assert abs(1 / (1 + math.exp(-sum(a * b for a, b in zip(h, net.w2, strict=True)) - net.b2)) - r.score) < 1e-3


def test_language_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).select("doc_id", "text").limit(6).unionByName(odd(spark).where("doc_id in (905)"))
    model = langid.make_model(["a", "b", "c"], seed=3)
    n = langid.HIDDEN

    def states(gru, steps):
        s, out = np.zeros(n), []
        for e in steps:
            a, u = e @ gru.x + gru.b, s @ gru.h[:, : 2 * n]
            z, r = (1 / (1 + np.exp(-(a[i : i + n] + u[i : i + n]))) for i in (0, n))
            s = s + z * (np.tanh(a[2 * n :] + (r * s) @ gru.h[:, 2 * n :]) - s)
            out.append(s)
        return out

    for r in langid.predict(docs, model).collect():
        total = np.zeros(3)
        for word in bytes(features.LOWER[np.frombuffer(r.text.encode(), np.uint8)]).split():
            word += b" "
            for at in range(0, len(word), langid.WINDOW):
                steps = [model.embed[c] for c in word[at : at + langid.WINDOW]]
                for left, right in zip(states(model.left, steps), states(model.right, steps[::-1])[::-1], strict=True):
                    logit = np.concatenate([left, right]) @ model.out + model.bias
                    total += logit - np.log(np.exp(logit).sum())
        p = np.exp(langid.TEMPER * (total - total.max()))
        p /= p.sum()
        assert r.lang_pred == "abc"[p.argmax()] and abs(r.score - p.max()) < 1e-3


def test_toxicity_query_and_odd_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.toxic for r in queries.op3_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = [(rows[i], bool(t)) for i, t in labels.items() if i in rows]
    assert sum(p == t for p, t in pairs) >= 0.95 * len(pairs)
    docs, labelled = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(odd(spark), toxicity.fit(docs, labelled, most=50)).collect()
    assert len(got) == len(ODD) and all(0 <= r.p_toxic <= 1 for r in got)
    none = toxicity.fit(docs, labelled.limit(0))
    assert toxicity.score(odd(spark), none).count() == len(ODD)
    with pytest.raises(ValueError, match="p_toxic"):
        toxicity.score(odd(spark).selectExpr("*", "1 as p_toxic"), none)

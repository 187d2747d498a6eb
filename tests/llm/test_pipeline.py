"""The pipeline's stages against brute force on the smallest tables, and odd rows through all of them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from ravelin.llm import pii, toxicity
from tests.conftest import SF
from tests.llm.test_packing import check
from tests.llm.test_pairs import slow_contamination
from tests.llm.test_pii import slow
from tests.llm.test_resemblance import slow_kept


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_by_brute_force(spark, docs):
    before = texts_of(docs)
    clean = P.drop_toxic(spark, docs, SF).cache()
    p = {r.doc_id: r.p_toxic for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert texts_of(clean) == {i: t for i, t in before.items() if p[i] < 0.5} != before

    rows = sorted(texts_of(clean).items())
    kept, _ = slow_kept([t for _, t in rows])
    single = P.keep_one_of_each(spark, clean, SF).cache()
    assert texts_of(single) == {i: t for k, (i, t) in enumerate(rows) if k in kept}
    assert single.count() < len(rows)

    rows = sorted(texts_of(single).items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = slow_contamination([t for _, t in rows], items)
    free = P.drop_contaminated(spark, single, SF).cache()
    assert texts_of(free) == {i: t for (i, t), h in zip(rows, hits, strict=True) if not h[1]}
    assert free.columns == docs.columns

    hidden = P.redact_personal_data(spark, free, SF).cache()
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(free).collect()}
    for r in hidden.collect():
        want, at = "", 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                want += before[r.doc_id][at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.stop)
        want += before[r.doc_id][at:]
        assert r.text == want and r.n_chars == len(want) and not slow(r.text)
    assert hidden.columns == docs.columns
    assert check(P.pack_sequences(spark, hidden, SF).collect(), texts_of(hidden), 2048) > 0.9


def test_run_equals_its_stages(spark, docs):
    table = docs
    for _, f in P.STAGES:
        table = f(spark, table, SF)
    columns = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert rows(P.run(spark, SF)) == rows(table)


def test_odd_rows_pass_every_stage(spark, docs):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (3, "same id", "en", "s", 7), (3, "same id", "en", "s", 7), (4, "é" * 100000, None, "s", None), (5, None, "en", None, 1)]
    extra = ["hits", "items", "n_words", "p_toxic", "p_abusive", "base", "spans", "candidates", "_key", "_hash", "_n", "node", "length", "ids", "_group", "sequence_id", "_column_0"]
    table = spark.createDataFrame(rows, docs.schema).withColumns({c: F.lit(c) for c in extra})
    columns = table.columns
    for _, f in P.STAGES[:-1]:
        table = f(spark, table, SF)
        assert table.columns == columns
    assert all(r[c] == c for r in table.collect() for c in extra)
    assert sorted((str(r.doc_id), (r.text or "")[:7]) for r in table.collect()) == [("1", ""), ("3", "same id"), ("4", "é" * 7), ("None", "no id")]
    want = len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("é" * 100000, add_special_tokens=False).ids) + 1
    packed = P.pack_sequences(spark, table, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 4) == want
    none = table.limit(0)
    for _, f in P.STAGES:
        none = f(spark, none, SF)
    assert none.count() == 0

"""Packing: ids equal to the tokenizer's, every id in one piece, gapless sequences, little padding."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ravelin.llm import packing, queries
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def wanted(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, capacity):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in texts.items():
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            if "ids" in r:
                assert list(r.ids) == want[at : at + r.length]
            at += r.length
        assert at == len(want)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert docs.keys() == texts.keys()
    return sum(r.length for r in rows) / (capacity * len(sequences))


def test_first_fit_decreasing_against_a_scan():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))]
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(20)
            room[b] -= sizes[i]
            want[i] = b
        assert packing.first_fit_decreasing(sizes, 20) == [want[i] for i in range(len(sizes))]


def test_odd_texts(spark):
    texts = dict(enumerate([None, "", "  \n", "don't you'll 'S", "A<|startoftext|>b <|ENDOFTEXT|> <|endoftext|>", "Straße ÀÉ é x y\x1cz\x85q", "Ὀδυσσεύς ΌΣΟΣ", "日本語 テキスト 123 4.5,", "w" * 3000, "a b! " * 3000, "İstanbul ...", "?! . word.", "😀👍🏽 ok", "́x"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack_documents(df, PATH, capacity=512).collect(), texts, 512)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_closing_punctuation_after_marks_and_signs():
    words = ["abc", "abc)", '"abc"', "abc%", "a/", '"x"', "é", "e\u0301", "है", "नहीं", "ที่", "😀", "I\u0307", "İ", "日本", "٣", "²", "ª", "𐐀", ")", "1", '"9233"329B"']
    chunks = [w + e for w in words for e in ("", ".", ",", "!!", ".,;", "?!")]
    got = packing.Encoder(Tokenizer.from_file(PATH).to_str()).learn({c.encode() for c in chunks})
    tokenizer = Tokenizer.from_file(PATH)
    for c in chunks:
        assert np.frombuffer(got[c.encode()], "<u4").tolist() == tokenizer.encode(c, add_special_tokens=False).ids, c


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers_on_odd_texts(name):
    """Ten thousand texts of symbol runs, quotes, brackets, marks, markup and code."""
    rng = random.Random(14)
    bits = ["abc", "Word", "I", "J\u030c", "H\u0331", "t\u0308", "e\u0301", "है", "नहीं", "ที่", "日本", "😀", "ß", "İ", "ΌΣΟΣ", "K", "don't", "'S", "9", "2024", "٣", "²", "<|endoftext|>", "<|", "</p>", "<div class=\"x\">", "**bold**", "f(x)[0];", "a_b", "x->y", "e.g.", "…", "“q”", "«r»", "\u200d", "\xa0", "\u3000", "\x1c", "\x85", "ﬁ"]
    signs = ".,;:!?()[]{}'\"`*_-+/%$#@<>|&~^=\\"
    texts = []
    for _ in range(10_000):
        parts = []
        for _ in range(rng.randint(0, 9)):
            parts.append(rng.choice(bits) if rng.random() < 0.6 else "".join(rng.choice(signs) for _ in range(rng.randint(1, 4))))
            if rng.random() < 0.4:
                parts.append(rng.choice([" ", "  ", "\n", "\t", "\r\n"]))
        texts.append("".join(parts))
    raw = [t.encode() for t in texts]
    path = public_tokenizers.path(name)
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(open(path, encoding="utf-8").read(), most=5000)
    assert encoder.spaceless == (name == "word_bpe_49k.json")
    for at in range(0, len(raw), 1000):
        part = raw[at : at + 1000]
        got = encoder.encode(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
        for t, g, e in zip(texts[at : at + 1000], got, tokenizer.encode_batch(texts[at : at + 1000], add_special_tokens=False), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == e.ids, t


def test_case_variants_share_one_entry_and_chunks_are_looked_up_once_a_slice():
    texts = [b"", b"Word WORD word. word", b"", "Élan 42 J\u030c J".encode(), b"  \n", b"a<|b Word"]
    encoder, tokenizer = packing.Encoder(Tokenizer.from_file(PATH).to_str()), Tokenizer.from_file(PATH)
    arrays = lambda some: (np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
    list(encoder.encode(*arrays(texts[:3])))
    assert encoder.kept.keys() == {b"word", b"."} and not encoder.aged
    for some in (texts, texts[:1], [texts[4]] * 2):
        got = list(encoder.encode(*arrays(some)))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in some]
    number, distinct, first = packing._chunks(*arrays(texts))
    assert distinct[:2] == [b"word", b"."] and number[:5].tolist() == [0, 0, 0, 1, 0] and first.tolist()[:3] == [0, 0, 5]


def test_a_tokenizer_that_keeps_case_or_space_is_encoded_whole():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    assert packing.drops_space(json.dumps(spec))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    assert not packing.drops_space(json.dumps(spec))
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    assert not packing.drops_space(json.dumps(spec))


def test_repeated_rows_and_long_documents_are_dealt_to_many_groups(spark):
    df = spark.range(3000).selectExpr("1L as doc_id", "'the very same text' as text").coalesce(2)
    got = packing.pack_documents(df, PATH, ids=False, group_docs=100).collect()
    assert len(got) == 3000
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) < 300
    long = spark.createDataFrame([(1, "a " * 300_000), (2, "b")], "doc_id long, text string").unionByName(spark.range(10, 310).selectExpr("id as doc_id", "'x' as text"))
    rows = packing.pack_documents(long, PATH, ids=False, capacity=512, group_docs=100).collect()
    assert len({r.sequence_id >> 32 for r in rows if r.doc_id == 1}) > 1 and sum(r.length for r in rows if r.doc_id == 1) == 300_001


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = packing.pack_documents(df, PATH, ids=False).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 3), ("1", 3), ("None", 2), ("None", 2)]


def test_whole_text_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "Hello  world\n")], "doc_id long, text string")
    got = packing.pack_documents(df, path, end_id=None).first()
    assert list(got.ids) == Tokenizer.from_file(path).encode("Hello  world\n", add_special_tokens=False).ids


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(queries.op5_packing(spark, SF).collect(), texts, 2048) > 0.95

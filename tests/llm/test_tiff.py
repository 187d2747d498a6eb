"""TIFF pages: exact round trips, hand-made files, faults."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from ravelin.llm import queries, tiff
from tests.conftest import SF


def samples(kind, h, w):
    rng = np.random.default_rng(h * 1000 + w)
    return {"noise": rng.integers(0, 256, (h, w), np.uint8), "flat": np.full((h, w), 7, np.uint8), "text": np.frombuffer((b"the cat sat on " * (h * w))[: h * w], np.uint8).reshape(h, w)}[kind]


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("kind", ["noise", "flat", "text"])
def test_round_trip(how, kind):
    for h, w in ((1, 1), (3, 64), (200, 64), (257, 130)):
        x = samples(kind, h, w)
        for predictor in (1, 2):
            for tile in (0, 16, 64):
                (page,) = tiff.pages(tiff.write_page(x, how, predictor, 50, tile))
                assert page.samples == x.tobytes() and (page.width, page.height, page.compression, page.predictor) == (w, h, how, predictor)


def test_codecs_on_known_bytes():
    # the example of the PackBits description
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(packed, len(plain)) == plain
    assert tiff.packbits_decode(b"\x80" + tiff.packbits_encode(plain), len(plain)) == plain
    # 7 7 7 8 8 7 7 6 6: the LZW example of TIFF 6.0: codes 256 7 258 8 8 258 6 6 257
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw
    rng = random.Random(4)
    for n in (0, 1, 2, 253, 254, 255, 256, 257, 3000, 60000):
        for alphabet in (1, 2, 256):
            x = bytes(rng.randrange(alphabet) for _ in range(n))
            assert tiff.lzw_decode(tiff.lzw_encode(x), n) == x


def test_big_endian_16_bit_rgb():
    x = np.arange(4 * 3 * 3, dtype=">u2").reshape(4, 3, 3) * 997
    d = np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1).astype(">u2")
    strip = zlib.compress(d.tobytes())
    fields = [(256, 3, 1, struct.pack(">HH", 3, 0)), (257, 3, 1, struct.pack(">HH", 4, 0)), (258, 3, 1, struct.pack(">HH", 16, 0)), (259, 3, 1, struct.pack(">HH", 8, 0)), (273, 4, 1, struct.pack(">I", 8)), (277, 3, 1, struct.pack(">HH", 3, 0)), (279, 4, 1, struct.pack(">I", len(strip))), (317, 3, 1, struct.pack(">HH", 2, 0))]
    raw = struct.pack(">2sHI", b"MM", 42, 8 + len(strip)) + strip + struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", *f[:3]) + f[3] for f in fields) + b"\0\0\0\0"
    (page,) = tiff.pages(raw)
    assert page.samples == x.astype("<u2").tobytes()


def test_read_pages_rows(spark):
    a, b = samples("text", 30, 64), samples("noise", 5, 16)
    two = tiff.join_pages([tiff.write_page(a, tiff.LZW), tiff.write_page(b, tiff.PACKBITS, tile=16)])
    loop = bytearray(tiff.write_page(b))
    at = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * struct.unpack_from("<H", loop, at)[0], at)
    rows = [(1, two), (2, None), (3, b""), (4, b"junk"), (5, two[: len(two) - 9]), (6, bytes(loop)), (1, two)]
    got = tiff.read_pages(spark.createDataFrame(rows, "id long, media binary")).collect()
    of = lambda i: [r for r in got if r.id == i]
    assert sorted((r.page, bytes(r.samples)) for r in of(1)) == sorted([(0, a.tobytes()), (1, b.tobytes())] * 2)
    assert not of(2) and not of(3)
    assert of(4)[0].error and of(4)[0].samples is None
    assert of(5)[-1].error and of(6)[-1].error == "directories form a loop"
    assert tiff.read_pages(spark.createDataFrame([], "id long, media binary")).count() == 0
    with pytest.raises(ValueError, match="width"):
        tiff.read_pages(spark.createDataFrame([(1, b"")], "width int, media binary"))


def fields_of(raw):
    """The places of a little-endian file's directory entries."""
    at = struct.unpack_from("<I", raw, 4)[0]
    return [at + 2 + 12 * i for i in range(struct.unpack_from("<H", raw, at)[0])]


@pytest.mark.parametrize("tile", [0, 16])
def test_broken_fields_are_errors_and_nothing_else(spark, tile):
    good = tiff.write_page(samples("text", 20, 32), tiff.LZW, 1, 8, tile)
    broken = []
    for place in fields_of(good):
        for shift, size in ((0, "H"), (2, "H"), (4, "I"), (8, "I")):
            for value in (0, 1, 2, 3, 5, 7, 13, 255, 65535, *((1 << 31, (1 << 32) - 1) if size == "I" else ())):
                bad = bytearray(good)
                struct.pack_into("<" + size, bad, place + shift, value)
                broken.append(bytes(bad))
    rng = random.Random(17)
    for _ in range(1500):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        broken.append(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])]))
    faults = 0
    for raw in broken:
        try:
            for p in tiff.pages(raw):
                assert len(p.samples) == p.width * p.height * p.channels * p.bits // 8
        except tiff.TiffError:
            faults += 1
    assert faults > len(broken) // 2
    rows = tiff.read_pages(spark.createDataFrame(list(enumerate(broken[:200])), "id long, media binary"))
    assert rows.where("(samples is null) = (error is null)").count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_tiff(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert {r.feature.split("/")[1] for r in got} == {"c5", "c8", "c32773"}


def test_store_texts_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 64), (4, "é" * 40000), (4, "é" * 40000)], "doc_id long, text string")
    got = tiff.read_pages(tiff.store_texts(df)).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.samples)) for r in got) == [(1, 0, 64), (2, 0, 64), (3, 64, 64), (4, 80000, 80000), (4, 80000, 80000)]

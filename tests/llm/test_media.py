from __future__ import annotations

import hashlib
import io
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparklex.llm import media


@pytest.mark.parametrize("shape", [(1, 1, 3), (5, 7, 3), (3, 64, 3), (2, 192), (9, 5)])
def test_round_trips(shape):
    pixels = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    coders = [media.encode_pgm] if len(shape) == 2 else [media.encode_ppm, media.encode_bmp]
    for coder in coders:
        assert (media.decode(coder(pixels)) == pixels).all()


def test_other_images():
    assert (media.decode(b"P5 # note\n2\n1 255\n\x01\x02") == [[1, 2]]).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == [[0, 255, 0], [255, 0, 255]]).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_exact(monkeypatch):
    monkeypatch.setattr(media, "BLOCK_ROWS", 3)
    image = np.random.default_rng(1).integers(0, 256, (37, 53), dtype=np.uint8)
    wide = np.kron(image.astype(float), np.ones((8, 9))).reshape(8, 37, 9, 53).mean((1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), wide)
    assert np.allclose(media.area_resize(image[:1], 32, 32)[0], media.area_resize(image[:1], 1, 32)[0])


def test_tiles_and_hashes(spark):
    ramp = np.tile(np.arange(64, dtype=np.uint8), (8, 1))
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16
    rows = spark.createDataFrame([(1, bytearray(media.encode_pgm(ramp))), (2, bytearray(b"broken")), (3, None), (4, bytearray(b"P5\n9 9\n255\nxx"))], "doc_id bigint, media binary")
    found = {r.doc_id: r for r in media.tiles(rows).collect()}
    assert np.load(io.BytesIO(found[1].tile)).shape == (32, 32) and found[1].width == 64
    assert all(found[i].tile is None for i in (2, 3, 4))


def test_text_features(spark, odd_docs, no_docs):
    rows = media.text_features(odd_docs).collect()
    assert len(rows) == odd_docs.count() and media.text_features(no_docs).collect() == []
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.pack_text(texts[r.doc_id])[0]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r.feature for r in rows if r.doc_id == 3}) == 1
    assert media.tiles(media.pack(odd_docs)).where("tile is null").count() == 0


def means(image, height, width):
    """Area means by exact fractions, pixel by pixel."""

    def shares(size, cells):
        out = []
        for c in range(cells):
            low, high = Fraction(size * c, cells), Fraction(size * (c + 1), cells)
            out.append([(p, min(high, p + 1) - max(low, p)) for p in range(int(low), min(size, int(high) + 1)) if min(high, p + 1) > max(low, p)])
        return out

    rows, columns = shares(len(image), height), shares(len(image[0]), width)
    area = Fraction(len(image), height) * Fraction(len(image[0]), width)
    return [[int(sum(image[y][x] * a * b for y, a in r for x, b in c) / area + Fraction(1, 2)) for c in columns] for r in rows]


def test_query_like_brute_force(spark):
    """All columns of the query, from images, tiles and hashes put together by hand."""
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("abc déf\n 日") for _ in range(rng.randrange(1500)))) for i in range(12)] + [(50, None), (51, ""), (52, "x" * 192)]
    found = {r.doc_id: r for r in media.text_features(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    kinds = set()
    for i, text in docs:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        kind = ("ppm", "pgm", "bmp")[zlib.crc32(payload) % 3]
        kinds.add(kind)
        height, wide = len(payload) // 192, 192 if kind == "pgm" else 64
        lines = [payload[192 * y : 192 * (y + 1)] for y in range(height)]
        if kind == "pgm":
            stored, grey = b"P5\n192 %d\n255\n" % height + payload, [list(line) for line in lines]
        else:
            grey = [[(299 * line[3 * x] + 587 * line[3 * x + 1] + 114 * line[3 * x + 2]) // 1000 for x in range(64)] for line in lines]
            stored = b"P6\n64 %d\n255\n" % height + payload
        if kind == "bmp":
            body = b"".join(bytes(v for x in range(64) for v in reversed(line[3 * x : 3 * x + 3])) for line in reversed(lines))
            head = [(54 + len(body), 4), (0, 4), (54, 4), (40, 4), (64, 4), (height, 4), (1, 2), (24, 2), (0, 4), (len(body), 4), (2835, 4), (2835, 4), (0, 4), (0, 4)]
            stored = b"BM" + b"".join(v.to_bytes(n, "little") for v, n in head) + body
        small = means(grey, 8, 9)
        bits = "".join(str(int(row[x] < row[x + 1])) for row in small for x in range(8))
        tile = b"".join(bytes(row) for row in means(grey, 32, 32))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert bytes(r.tile)[:6] == b"\x93NUMPY" and bytes(r.tile)[-1024:] == tile and len(r.tile) == 1152
        assert r.feature == f"{kind}:{wide}x{height}:{int(bits, 2):016x}:{zlib.crc32(bytes(r.tile)):08x}"
    assert kinds == {"ppm", "pgm", "bmp"}

from __future__ import annotations

import random

import numpy as np
import pytest

from sparklex.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder()


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.bpe.ranks, special_tokens={})


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode_texts([text])[0], "<u4").tolist()


def test_like_the_library(encoder, reference):
    rng = random.Random(4)
    texts = ["", "a", "it's we'LL", " \n\t x  ", "aaaa" * 500, "日本語🎉½Ⅷ", "<|endoftext|>", "\x1c\x85 a", "é" * 200]
    texts += ["".join(chr(rng.choice([32, 39, *range(97, 123), *range(0xC0, 0x250), 0x4E2D])) for _ in range(rng.randrange(400))) for _ in range(200)]
    for text in texts:
        assert ids_of(encoder, text) == reference.encode_ordinary(text)
        assert encoder.decode_ids(encoder.encode_texts([text])[0]) == text.encode()


def test_both_trees_agree(encoder):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("theranding ") for _ in range(rng.randrange(2, 65))).encode() for _ in range(300)]
    merged = encoder.bpe.encode_pieces(list(dict.fromkeys(pieces)))
    for piece in pieces:
        if piece not in encoder.bpe.ranks:
            assert merged[piece] == encoder.bpe.merge_one(piece).astype("<u4").tobytes()


def test_a_full_cache_changes_nothing(reference):
    small = bpe.TextEncoder(cache_bytes=3)
    for text in ("one two three four five", "five six", "one"):
        assert ids_of(small, text) == reference.encode_ordinary(text)


def test_rows(spark, odd_docs, no_docs, reference):
    rows = bpe.digests(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_tokens == by_id[2].n_tokens == 0 and by_id[3].n_tokens == len(reference.encode_ordinary("One two three."))
    assert bpe.digests(no_docs).collect() == []
    coded = bpe.encode(odd_docs)
    texts = {r.doc_id: r.text for r in bpe.decode(coded).collect()}
    assert {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()} == texts

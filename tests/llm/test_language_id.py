from __future__ import annotations

import decimal
import os
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklex.llm import language_id as l

FOLDER = "/root/testdata/sf0.001"


RANKS = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4, b"ba": 5}


def brute(raw, table, ranks=RANKS):
    """Sum over all segmentations, written out."""
    if not raw:
        return np.ones(table.shape[1])
    return sum((table[ranks[raw[:n]]] * brute(raw[n:], table, ranks) for n in range(1, len(raw) + 1) if raw[:n] in ranks), np.zeros(table.shape[1]))


def exact(raw, table, language):
    """The same place by place, in decimals of 40 digits and any exponent."""
    decimal.getcontext().prec = 40
    sums = [decimal.Decimal(1)] + [decimal.Decimal(0)] * len(raw)
    for end in range(1, len(raw) + 1):
        for n in (1, 2):
            if n <= end and raw[end - n : end] in RANKS:
                sums[end] += sums[end - n] * decimal.Decimal(float(table[RANKS[raw[end - n : end]], language]))
    return float(sums[-1].ln())


def test_forward_sums_all_segmentations():
    table = np.random.default_rng(0).random((6, 2))
    words = ["abab", "b", "a", "babba"]
    vocabulary = l.Vocabulary(RANKS)
    assert np.allclose(l.word_scores(vocabulary, table, words), np.log([brute(l.encoded(w), table) for w in words]))
    times, step = {"abab": 1, "b": 2, "a": 1, "babba": 3}, 1e-6
    counts = l.word_counts(vocabulary, table[:, 0], times)
    for piece in range(6):  # the posterior count is the derivative of the log likelihood by the log probability
        up = table.copy()
        up[piece, 0] *= 1 + step
        slope = (np.array(list(times.values())) @ (l.word_scores(vocabulary, up, words)[:, 0] - l.word_scores(vocabulary, table, words)[:, 0])) / step
        assert counts[piece] == pytest.approx(slope, abs=1e-3)


@pytest.mark.parametrize("length", [27, 28, 29, 200, 2100, 5000])
@pytest.mark.parametrize("factor", [1.0, 1e-9])
def test_words_of_any_length_are_summed_whole(length, factor):
    """Many digits against all paths, for likely and unlikely pieces; long words mix with short ones."""
    rng = np.random.default_rng(length)
    table = rng.random((6, 2)) * np.array([factor, 0.5])
    words = ["".join("ab"[i] for i in rng.integers(0, 2, length)), "ab", "".join("ab"[i] for i in rng.integers(0, 2, length // 2))]
    vocabulary = l.Vocabulary(RANKS)
    wanted = np.array([[exact(l.encoded(w), table, k) for k in (0, 1)] for w in words])
    assert np.allclose(l.word_scores(vocabulary, table, words), wanted, rtol=1e-9)
    assert np.allclose(l.long_log_likelihood(vocabulary, table, l.encoded(words[0])), wanted[0], rtol=1e-9)


def test_counts_of_long_words():
    """The counts of a long word are those of its lattice, and cover each of its bytes once."""
    table = np.random.default_rng(5).random(6)
    vocabulary, word = l.Vocabulary(RANKS), "abba" * 40
    counts = l.word_counts(vocabulary, table, {word: 2})
    assert sum(len(piece) * counts[rank] for piece, rank in RANKS.items()) == pytest.approx(2 * (len(word) + 1))
    short = "abba" * 6
    plain = l.Lattice(vocabulary, [l.encoded(short)]).expected_counts(table, np.array([1.0]))
    slow = l.long_expected_counts(vocabulary, table, l.encoded(short), 1.0)
    assert np.allclose(plain, [slow.get(i, 0.0) for i in range(6)])


def test_a_very_long_word_takes_linear_time():
    vocabulary = l.Vocabulary(l._vocabulary(None))
    table = np.full((vocabulary.size, 4), 1.0 / vocabulary.size)
    began = time.perf_counter()
    out = l.word_scores(vocabulary, table, ["日本語の文" * 14_000])
    assert np.isfinite(out).all() and (out < -1e5).all() and time.perf_counter() - began < 20


def test_predictions_like_brute_force(spark):
    """The query's steps on a small table: the same languages and scores as sums over single words say."""
    texts = {"en": "the cat and the dog", "fr": "le chat et le chien là", "de": "die Katze und der Hund"}
    rows = [(i, t * (1 + i % 3), lang) for i, (lang, t) in enumerate(list(texts.items()) * 6)] + [(100, "the dog là", None), (101, "", None), (102, None, None), (103, "12 !", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    langs, table = model = l.fit(docs, ~l.held_out())
    assert langs == ["de", "en", "fr"] and np.allclose(table.sum(0), 1)
    vocabulary = l.Vocabulary(l._vocabulary(None))
    for r in l.predict(docs, model).collect():
        words = l.words_of(next(t for i, t, _ in rows if i == r.doc_id) or "")
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(l.long_log_likelihood(vocabulary, table, l.encoded(w)) for w in words)
        odds = np.exp(total - total.max())
        assert r.lang_pred == langs[int(total.argmax())] and r.score == pytest.approx(odds.max() / odds.sum())


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in l.predict(docs, l.fit(docs, F.lit(True))).collect()} == {("a", 0.5)}


def test_sample_is_bounded_and_even(spark, monkeypatch):
    rows = [(i, "x", "common") for i in range(3000)] + [(5000 + i, "x", "rare") for i in range(50)] + [(9000 + i, "x", f"noise{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(l, "MAX_LANGUAGES", 5)
    counts = {r.lang: r["count"] for r in l.training_sample(docs, F.lit(True), max_train_docs=500).groupBy("lang").count().collect()}
    assert counts.pop("rare") == 50 and 350 < counts.pop("common") < 550 and counts == {"noise0": 1, "noise1": 1, "noise10": 1}


def test_rows(spark, odd_docs, no_docs):
    model = l.fit(odd_docs, F.lit(True))
    assert model[0] == ["en", "es", "fr"]
    found = {r.doc_id: r for r in l.predict(odd_docs, model).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[5].lang_pred == "und" and found[1].score == 0.0
    assert found[4].lang_pred == "en" and 0 < found[4].score <= 1
    assert l.predict(odd_docs, model).count() == odd_docs.count()
    nothing = l.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in l.predict(odd_docs, nothing).collect()} == {"und"} and l.predict(no_docs, model).collect() == []


def test_held_out(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", l.held_out())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.collect())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the standard tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = l.fit(docs, ~l.held_out())
    judged = l.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(l.held_out())
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95

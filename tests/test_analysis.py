"""Tokenizers, filters, edit distance, numbers and scoring."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from sparklex.functions.patterns import java_regex
from sparklex.functions.scoring import Bm25, byte_levenshtein, cosine, idf, wildcard_regex
from sparklex.functions.text import (
    ENGLISH_STOP_WORDS, Analyzer, StopWordFilter, english_stop_words, has_phrase, has_prefix, lowercase_filter, standard_tokenizer, token_count, whitespace_tokenizer,
)
from sparklex.functions.values import decode_float64, decode_int64, encode_float64, encode_int64, infer_type, parse_float


def values(spark, expression, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Hello, World!", ["hello", "world"]),
        ("foo-bar", ["foo", "bar"]),
        ("abc1def a$b", ["abcdef", "ab"]),
        ("  two  spaces ", ["two", "spaces"]),
        ("", []),
        ("Über ÉTÉ", ["über", "été"]),
        ("12 34", []),
    ],
)
def test_standard_tokenizer(spark, text, tokens):
    assert values(spark, standard_tokenizer, [text]) == [tokens]


def test_whitespace_tokenizer_keeps_case_and_marks(spark):
    assert values(spark, whitespace_tokenizer, ["Hello,\t World!", "", None]) == [["Hello,", "World!"], [], None]


def test_stop_words_keep_positions(spark):
    assert len(ENGLISH_STOP_WORDS) == 54
    analyzer = Analyzer(standard_tokenizer, (english_stop_words,))
    assert values(spark, analyzer, ["The Quick Fox"]) == [[None, "quick", "fox"]]
    assert values(spark, lambda c: token_count(analyzer(c)), ["The Quick Fox"]) == [2]
    assert values(spark, lambda c: StopWordFilter(()).add("FOX")(standard_tokenizer(c)), ["a fox"]) == [["a", None]]
    assert values(spark, Analyzer(whitespace_tokenizer, (lowercase_filter,)), ["A-B c"]) == [["a-b", "c"]]


def test_phrase_needs_neighbours(spark):
    tokens = ["i love new york city", "new is york", "york new"]
    assert values(spark, lambda c: has_phrase(standard_tokenizer(c), ["new", "york"]), tokens) == [True, False, False]
    assert values(spark, lambda c: has_phrase(standard_tokenizer(c), []), tokens) == [False] * 3
    assert values(spark, lambda c: has_phrase(F.array(c), ["new", "york"]), ["new york"]) == [False]


@pytest.mark.parametrize("a, b, d", [("kitten", "sitting", 3), ("", "abc", 3), ("go", "go", 0), ("é", "e", 2), ("flaw", "lawn", 2)])
def test_edit_distance_is_over_bytes(spark, a, b, d):
    assert values(spark, lambda c: byte_levenshtein(c, F.lit(b)), [a]) == [d]


def test_inferred_types(spark):
    given = ["42", "-7", "3.14", "1e400", "true", "TRUE", "word", "two words", "", "x" * 64, "1d", " 1", "inf", None, "99999999999999999999"]
    wanted = ["integer", "integer", "float", "keyword", "boolean", "keyword", "keyword", "text", "keyword", "text", "keyword", "text", "float", None, "float"]
    assert values(spark, infer_type, given) == wanted


def test_parse_float(spark):
    assert values(spark, parse_float, ["1.5", ".5", "5.", "1e3", "N/A", "1 ", None]) == [1.5, 0.5, 5.0, 1000.0, None, None, None]


def test_codes_sort_as_numbers(spark):
    numbers = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    codes = values(spark, encode_int64, numbers, "v bigint")
    assert codes == sorted(codes)
    assert values(spark, decode_int64, codes) == numbers


def test_bm25_values(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    for n, df, wanted in ((10, 1, 1.993), (10, 10, 0.047), (10, 5, 0.693)):
        assert get(idf(F.lit(float(n)), F.lit(float(df)))) == pytest.approx(wanted, abs=1e-3)
    for f, length, average, wanted in ((1, 5, 5, 1.0), (1, 10, 5, 0.710), (10, 5, 5, 1.964)):
        assert get(Bm25().tf(F.lit(f), F.lit(length), F.lit(float(average)))) == pytest.approx(wanted, abs=1e-3)
    assert get(Bm25().tf(F.lit(1), F.lit(0), F.lit(0.0))) == 0.0


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 2.0], [-1.0, -2.0], -1), ([0.0, 0.0], [1.0, 1.0], 0), ([1.0], [1.0, 2.0], 0), ([1.0, 2.0], [2.0, 4.0], 1)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([w for _, _, w in pairs])


def test_patterns(spark):
    match = lambda p, words: [w for w in words if values(spark, lambda c: c.rlike(wildcard_regex(p)), [w])[0]]
    assert match("go*", ["golang", "python", "go"]) == ["golang", "go"]
    assert match("g?", ["go", "g", "gone"]) == ["go"]
    assert match("a.c", ["abc", "a.c"]) == ["a.c"]
    assert java_regex("(?=a)b") is None and java_regex("(") is None and java_regex(r"(a)\1") is None
    assert java_regex("^act") is not None


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        (r"^C\++$", ["C+", "C++"], ["C", "CC"]),
        (r"[-*+/]x", ["-x", "/x"], ["x", "ax"]),
        (r"\Qa.b\E", ["a.b"], ["axb"]),
        (r"^x(?i)y$", ["xy", "xY"], ["Xy"]),
        (r"^\\1$", ["\\1"], ["1"]),
        (r"a$", ["a", "ba"], ["a\n"]),
        (r"(?m)^b$", ["a\nb\nc"], ["ab"]),
        (r"^a.c$", ["abc", "a\rc"], ["a\nc"]),
        (r"^[[:alpha:]]+[^[:^digit:]]$", ["ab1"], ["1", "ab"]),
        (r"^\s$", ["\t"], ["\x0b"]),
        (r"\bcat\b", ["a cat.", "\u00e9cat"], ["cats"]),
        (r"^[]a]+$", ["]a"], ["b"]),
        (r"^a{2}b{,3}$", ["aab{,3}"], ["aabbb"]),
        (r"^\x41\x{1F600}\101$", ["A\U0001F600A"], ["AA"]),
        (r"^\pL\p{Greek}\PN$", ["a\u03b1x"], ["a\u03b11"]),
        (r"^(?P<a_b>x|y)*?$", ["xyx", ""], ["z"]),
        (r"(?s:^a.b$)|^$", ["a\nb", ""], ["ab"]),
    ],
)
def test_patterns(spark, pattern, yes, no):
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").where(F.col("t").rlike(java_regex(pattern))).collect()
    assert sorted(r.t for r in rows) == sorted(yes)


def test_refused_patterns():
    for pattern in ("(?=a)b", "(?<!a)b", r"(a)\1", "a**", "a*+", "a{2}{3}", "x{1001}", "(a{100}){100}", "[z-a]", "[a", "(a", "a)", "*a", "(|*)", r"\p{nope}", r"\q", "a\\", "(?P<n>a)(?P<n>b)", "(?<>a)", "(?z)a", r"[[:nope:]]"):
        assert java_regex(pattern) is None, pattern


def test_phrases_with_separators_in_tokens(spark):
    texts = ["a\x01b a", "x a b", "a \x02 b", "a\x01b", "b a"]
    tokens = lambda c: whitespace_tokenizer(c)
    assert values(spark, lambda c: has_phrase(tokens(c), ["a", "b"]), texts) == [False, True, False, False, False]
    assert values(spark, lambda c: has_phrase(tokens(c), ["a\x01b"]), texts) == [True, False, False, True, False]
    assert values(spark, lambda c: has_phrase(F.array(F.lit("a"), F.lit(None).cast("string"), c), ["a", "\x02"]), ["b"]) == [False]
    assert values(spark, lambda c: has_prefix(tokens(c), "b"), texts) == [False, True, True, False, True]
    assert values(spark, lambda c: has_prefix(tokens(c), "a\x01"), texts) == [True, False, False, True, False]


def test_float_codes(spark):
    numbers = [float("-inf"), -1e300, -2.5, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.5, 2.0, 1e300, float("inf")]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", encode_float64(F.col("x")).alias("code")).select("x", "code", decode_float64(F.col("code")).alias("back")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.code)] == numbers and all(str(r.x) == str(r.back) for r in rows)

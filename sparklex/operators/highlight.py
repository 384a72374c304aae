"""Highlighting of matched terms in stored text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import Analyzer, whitespace_tokenizer


def highlight(value: Column, terms: Column, analyzer: Analyzer, opening: str, closing: str) -> Column:
    """The text with marked words, joined by single blanks; NULL if no word is marked.

    A word is marked if the first token it is analysed to is among the terms.
    """

    def first_token(word: Column) -> Column:
        return F.get(F.array_compact(analyzer(word)), F.lit(0))

    def judged(word: Column) -> Column:
        return F.named_struct(F.lit("word"), word, F.lit("hit"), F.coalesce(F.array_contains(terms, first_token(word)), F.lit(False)))

    def marked(words: Column) -> Column:
        text = F.array_join(F.transform(words, lambda w: F.when(w["hit"], F.concat(F.lit(opening), w["word"], F.lit(closing))).otherwise(w["word"])), " ")
        return F.when(F.exists(words, lambda w: w["hit"]), text)

    # Bound by a lambda, so that every word is analysed once.
    once = F.array(F.transform(whitespace_tokenizer(value), judged))
    return F.get(F.transform(once, marked), F.lit(0))


def highlights(fields: list[str], terms: Column, analyzer: Analyzer, opening: str, closing: str) -> Column:
    """Array of ``(field, snippet)`` of the fields with a hit, by field name."""
    if not fields:
        return F.array().cast("array<struct<field:string,snippet:string>>")
    snippets = [
        F.struct(F.lit(f).alias("field"), highlight(F.col(f"v_{f}"), terms, analyzer, opening, closing).alias("snippet"))
        for f in sorted(fields)
    ]
    return F.filter(F.array(*snippets), lambda s: s["snippet"].isNotNull())

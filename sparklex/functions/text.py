"""Text analysis as Column expressions: tokenizers, filters, analyzers.

Tokens are an ``array<string>``.  A filter that removes a token leaves a NULL in
its place, so the index of an element is the token's position and phrases over
filtered text keep their distances.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Unicode property: one test for each character, where a list of ranges would take a dozen.
WS = r"\p{IsWhite_Space}"

# The 54 English stop words.
ENGLISH_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "in", "on", "at", "to", "for", "of", "with",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they", "their",
    "this", "that", "these", "those",
    "not", "no", "nor",
)

Tokenizer = Callable[[Column], Column]
TokenFilter = Callable[[Column], Column]


def whitespace_tokenizer(text: Column) -> Column:
    """Runs of anything but white space, case and punctuation kept."""
    return F.regexp_extract_all(text, F.lit(f"[^{WS}]++"), F.lit(0))


def standard_tokenizer(text: Column) -> Column:
    """Lower-cased runs of letters; white space and punctuation separate, all else is deleted."""
    kept = F.lower(F.regexp_replace(text, rf"[^\p{{L}}\p{{P}}{WS}]", ""))
    return F.regexp_extract_all(kept, F.lit(rf"[^\p{{P}}{WS}]++"), F.lit(0))


def lowercase_filter(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


@dataclass(frozen=True)
class StopWordFilter:
    """Removes words, given in any case; positions of the others stay."""

    words: tuple[str, ...] = ENGLISH_STOP_WORDS

    def add(self, *words: str) -> "StopWordFilter":
        return StopWordFilter((*self.words, *words))

    def __call__(self, tokens: Column) -> Column:
        lowered = sorted({w.lower() for w in self.words})
        return F.transform(tokens, lambda t: F.when(~t.isin(*lowered), t)) if lowered else tokens


english_stop_words = StopWordFilter()


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer and the filters that follow it, in order."""

    tokenizer: Tokenizer = standard_tokenizer
    filters: tuple[TokenFilter, ...] = ()

    def __call__(self, text: Column) -> Column:
        tokens = self.tokenizer(text)
        for step in self.filters:
            tokens = step(tokens)
        return tokens


def token_count(tokens: Column) -> Column:
    """Tokens left after filtering."""
    return F.size(F.array_compact(tokens)).cast("int")


def term_frequency(tokens: Column, term: str | Column) -> Column:
    """How often a term occurs; stays inside generated code, unlike a lambda."""
    return F.coalesce(F.size(tokens) - F.size(F.array_remove(tokens, term)), F.lit(0))


def has_term(tokens: Column, term: str) -> Column:
    return F.coalesce(F.array_contains(tokens, term), F.lit(False))


#: Stands between terms, and for removed ones, in a joined token array.
_BETWEEN, _REMOVED = "\x01", "\x02"


def has_phrase(tokens: Column, terms: list[str]) -> Column:
    """True where the terms stand at consecutive positions; an empty phrase is nowhere.

    The tokens are joined once and searched as a string, which stays inside
    generated code.  Only of the few rows found so whose tokens hold a separator
    themselves are the positions compared.
    """
    if not terms:
        return F.lit(False)
    last = F.size(tokens) - len(terms)

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, term in enumerate(terms):
            out = out & F.coalesce(F.get(tokens, i + k) == term, F.lit(False))
        return out

    exact = F.exists(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), here)
    found = F.contains(_joined(tokens), F.lit(_BETWEEN + _BETWEEN.join(terms) + _BETWEEN))
    return F.coalesce(found & (_plain(tokens, terms) | exact), F.lit(False))


def has_prefix(tokens: Column, start: str) -> Column:
    """True where a term starts so; searched like a phrase."""
    if not start:
        return F.coalesce(F.size(F.array_compact(tokens)) > 0, F.lit(False))
    exact = F.coalesce(F.exists(tokens, lambda t: F.coalesce(F.startswith(t, F.lit(start)), F.lit(False))), F.lit(False))
    found = F.contains(_joined(tokens), F.lit(_BETWEEN + start))
    return F.coalesce(found & (_plain(tokens, [start]) | exact), F.lit(False))


def _plain(tokens: Column, terms: list[str]) -> Column:
    """True where neither the terms nor any token hold a separator, so that a joined search is exact."""
    if any(c in term for term in terms for c in (_BETWEEN, _REMOVED)):
        return F.lit(False)
    together = F.array_join(tokens, "")
    return ~F.contains(together, F.lit(_BETWEEN)) & ~F.contains(together, F.lit(_REMOVED))


def _joined(tokens: Column) -> Column:
    return F.concat(F.lit(_BETWEEN), F.array_join(tokens, _BETWEEN, _REMOVED), F.lit(_BETWEEN))

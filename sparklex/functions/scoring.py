"""Relevance and similarity as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    """BM25 parameters."""

    k1: float = 1.2
    b: float = 0.75

    def tf(self, freq: Column, length: Column, average: Column) -> Column:
        """Saturated term frequency; 0 where the field's average length is 0."""
        return F.when(average > 0, freq * (self.k1 + 1.0) / (freq + self.k1 * (1.0 - self.b + self.b * (length / average)))).otherwise(0.0)

    def score(self, n: Column, df: Column, freq: Column, length: Column, average: Column, boost: Column) -> Column:
        return idf(n, df) * self.tf(freq, length, average) * boost


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency of a term in ``df`` of ``n`` documents."""
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 where lengths differ or a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes."""
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b))


def within_distance(term: Column, target: str, distance: int) -> Column:
    """True where the byte edit distance is at most ``distance``; lengths are compared first."""
    size = len(target.encode())
    near = F.octet_length(term).between(size - distance, size + distance)
    return near & (byte_levenshtein(term, F.lit(target)) <= distance)


def wildcard_regex(pattern: str) -> str:
    """Java pattern of a whole-term wildcard: ``*`` any run, ``?`` one character."""
    parts = {"*": ".*", "?": "."}
    return "(?d)^" + "".join(parts.get(c, re.escape(c)) for c in pattern) + r"\z"

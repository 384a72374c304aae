"""Queries as immutable values, a fluent builder, and synonym rewriting."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

MUST, SHOULD, MUST_NOT, PHRASE = "must", "should", "must_not", "phrase"


@dataclass(frozen=True)
class Clause:
    """One term of a field, or a phrase (its terms joined by blanks)."""

    kind: str
    field: str
    term: str

    @property
    def terms(self) -> list[str]:
        return self.term.split() if self.kind == PHRASE else [self.term]


@dataclass(frozen=True)
class Range:
    """Bounds on a numeric field; None leaves a side open."""

    field: str
    gte: float | None = None
    lte: float | None = None
    gt: float | None = None
    lt: float | None = None


@dataclass(frozen=True)
class Terms:
    """The raw value equals any of ``values``."""

    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Regex:
    """The pattern occurs in the raw value."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = ()
    ranges: tuple[Range, ...] = ()
    terms: tuple[Terms, ...] = ()
    regexes: tuple[Regex, ...] = ()

    def with_synonyms(self, synonyms: Mapping[str, tuple[str, ...]]) -> "Query":
        """Clauses with synonyms become optional ones, beside one for each synonym.

        Exclusions and phrases stay as they are, and so do all filters.
        """
        out: list[Clause] = []
        for clause in self.clauses:
            same = () if clause.kind in (MUST_NOT, PHRASE) else tuple(synonyms.get(clause.term, ()))
            out += [Clause(SHOULD, clause.field, t) for t in (clause.term, *same)] if same else [clause]
        return replace(self, clauses=tuple(out))


@dataclass
class Builder:
    """Collects clauses and filters: ``Builder().must("body", "spark").range("price", gte=1).build()``."""

    _query: Query = field(default_factory=Query)

    def _clause(self, kind: str, field_: str, term: str) -> "Builder":
        self._query = replace(self._query, clauses=(*self._query.clauses, Clause(kind, field_, term)))
        return self

    def must(self, field: str, term: str) -> "Builder":
        return self._clause(MUST, field, term)

    def should(self, field: str, term: str) -> "Builder":
        return self._clause(SHOULD, field, term)

    def must_not(self, field: str, term: str) -> "Builder":
        return self._clause(MUST_NOT, field, term)

    def phrase(self, field: str, *terms: str) -> "Builder":
        return self._clause(PHRASE, field, " ".join(terms))

    def range(self, field: str, gte: float | None = None, lte: float | None = None, gt: float | None = None, lt: float | None = None) -> "Builder":
        self._query = replace(self._query, ranges=(*self._query.ranges, Range(field, gte, lte, gt, lt)))
        return self

    def terms(self, field: str, *values: str) -> "Builder":
        self._query = replace(self._query, terms=(*self._query.terms, Terms(field, values)))
        return self

    def regex(self, field: str, pattern: str) -> "Builder":
        self._query = replace(self._query, regexes=(*self._query.regexes, Regex(field, pattern)))
        return self

    def build(self) -> Query:
        return self._query

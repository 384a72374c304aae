"""Predicates over an analysed corpus: clauses, ranges, terms and regexes.

Filters stay plain comparisons, NULL where a value is absent: as conjuncts of a
WHERE they exclude such rows, and the optimizer can move them into the scan.
"""

from __future__ import annotations

import math
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import java_regex
from ..functions.text import has_phrase, has_term
from ..plans.mapping import Schema
from ..plans.query import MUST, MUST_NOT, PHRASE, SHOULD, Clause, Query, Range, Regex, Terms


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def holds(corpus: DataFrame, clause: Clause) -> Column:
    """True where a document has the clause's term or phrase."""
    column = f"t_{clause.field}"
    if column not in corpus.columns:
        return F.lit(False)
    if clause.kind != PHRASE and f"r_{clause.field}" in corpus.columns:
        return F.coalesce(F.col(f"r_{clause.field}") == clause.term, F.lit(False))
    if clause.kind == PHRASE:
        return has_phrase(F.col(column), clause.terms)
    return has_term(F.col(column), clause.term)


def candidate(corpus: DataFrame, query: Query) -> Column:
    """True where any term of any clause occurs, excluded ones too: other documents are never looked at."""
    singles = {(c.field, t) for c in query.clauses for t in c.terms}
    return any_of([holds(corpus, Clause(MUST, f, t)) for f, t in sorted(singles)])


def matches(corpus: DataFrame, query: Query) -> Column:
    """The boolean rule: all musts and phrases, no exclusion, and a should if there is no must."""
    by_kind = {kind: [holds(corpus, c) for c in query.clauses if c.kind == kind] for kind in (MUST, SHOULD, MUST_NOT, PHRASE)}
    rule = all_of(by_kind[MUST] + by_kind[PHRASE] + [~x for x in by_kind[MUST_NOT]])
    if by_kind[SHOULD] and not by_kind[MUST]:
        rule = rule & any_of(by_kind[SHOULD])
    return rule & candidate(corpus, query)


def in_range(corpus: DataFrame, bounds: Range) -> Column:
    """Within all bounds; a field that is absent or not an indexed number excludes."""
    name = f"n_{bounds.field}"
    if name not in corpus.columns:
        return F.lit(False)
    value = F.col(name)
    if isinstance(corpus.schema[name].dataType, T.IntegralType):
        return all_of([value.isNotNull(), *_whole_bounds(value, bounds)])
    tests = [value.isNotNull() & ~F.isnan(value)]
    tests += [] if bounds.gte is None else [value >= float(bounds.gte)]
    tests += [] if bounds.lte is None else [value <= float(bounds.lte)]
    tests += [] if bounds.gt is None else [value > float(bounds.gt)]
    tests += [] if bounds.lt is None else [value < float(bounds.lt)]
    return all_of(tests)


def _whole_bounds(value: Column, bounds: Range) -> list[Column]:
    """Bounds on a whole number as whole numbers, which a scan can use; those beyond 64 bits hold for all or none."""
    out = []
    for bound, lower, open_ in ((bounds.gte, True, False), (bounds.lte, False, False), (bounds.gt, True, True), (bounds.lt, False, True)):
        if bound is None:
            continue
        if math.isnan(bound):
            out.append(F.lit(False))
        elif math.isinf(bound) or not -(1 << 63) <= bound < 1 << 63:
            out.append(F.lit((bound < 0) == lower))
        elif lower:
            out.append(value > F.lit(math.floor(bound)).cast("bigint") if open_ else value >= F.lit(math.ceil(bound)).cast("bigint"))
        else:
            out.append(value < F.lit(math.ceil(bound)).cast("bigint") if open_ else value <= F.lit(math.floor(bound)).cast("bigint"))
    return out


def _stored(corpus: DataFrame, schema: Schema, field: str) -> Column | None:
    return F.col(f"v_{field}") if f"v_{field}" in corpus.columns and schema[field].store else None


def in_terms(corpus: DataFrame, schema: Schema, terms: Terms) -> Column:
    """The stored value equals one of those given; none given excludes all."""
    value = _stored(corpus, schema, terms.field)
    if value is None or not terms.values:
        return F.lit(False)
    return value.isin(*terms.values)


def in_regex(corpus: DataFrame, schema: Schema, regex: Regex) -> Column:
    """The pattern occurs in the stored value; one that does not compile excludes all."""
    value, pattern = _stored(corpus, schema, regex.field), java_regex(regex.pattern)
    if value is None or pattern is None or not _compiles(corpus, pattern):
        return F.lit(False)
    return value.rlike(pattern)


def _compiles(corpus: DataFrame, pattern: str) -> bool:
    """Does the JVM know all classes of a pattern?  Asked once, before any row is read."""
    try:
        corpus.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Py4JJavaError:
        return False


def passes(corpus: DataFrame, schema: Schema, query: Query) -> Column:
    """All ranges, terms and regexes of a query."""
    return all_of(
        [in_range(corpus, r) for r in query.ranges]
        + [in_terms(corpus, schema, t) for t in query.terms]
        + [in_regex(corpus, schema, r) for r in query.regexes]
    )

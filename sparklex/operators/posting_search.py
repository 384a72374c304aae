"""Search over a stored inverted index: ranked boolean queries and term expansion.

Only the postings of the query's own terms are read: the field picks a partition,
the term a few row groups.  They are gathered by document, matched and scored
without touching the documents, which are joined for filters and fields, and if
nothing but the score orders them, for the top rows alone.  Fuzzy and wildcard
searches test the terms of the stored dictionary, and prefixes are a range of
terms, so neither reads a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Bm25, idf
from ..plans.query import MUST, MUST_NOT, PHRASE, SHOULD, Clause, Query
from .filters import all_of, any_of
from .search import Statistics


@dataclass(frozen=True)
class StoredIndex:
    """Postings ``field, term, doc_id, freq, positions, length, boost``; ``field, n_docs, avg_length``; terms ``field, term, df``.

    ``indexed`` names the fields that have postings; others have lengths only.
    """

    postings: DataFrame
    field_stats: DataFrame
    terms: DataFrame
    indexed: tuple[str, ...]

    def statistics(self, n_rows: int | None = None) -> Statistics:
        """Corpus size and average lengths; one row for each field is collected."""
        rows = self.field_stats.collect()
        n = sum(r.n_docs for r in rows if r.field in self.indexed) if n_rows is None else n_rows
        return Statistics(n, {r.field: r.avg_length for r in rows})


def _wanted(query: Query) -> list[tuple[str, str]]:
    return list(dict.fromkeys((c.field, t) for c in query.clauses for t in c.terms))


def _of_terms(table: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """The rows of a table by field and term that some terms have."""
    fields = sorted({f for f, _ in wanted})
    rule = any_of([(F.col("field") == f) & F.col("term").isin(*[t for g, t in wanted if g == f]) for f in fields])
    return table.where(F.col("field").isin(*fields) & F.col("term").isin(*[t for _, t in wanted]) & rule)


def _consecutive(positions: list[Column]) -> Column:
    """True where some position of the first is followed by the others, one by one."""
    first, rest = positions[0], positions[1:]
    return F.coalesce(F.exists(first, lambda p: all_of([F.array_contains(q, p + k + 1) for k, q in enumerate(rest)])), F.lit(False))


def match_postings(index: StoredIndex, query: Query, bm25: Bm25, n_rows: int | None = None) -> DataFrame:
    """``doc_id, score, terms`` of the documents that match a query with clauses."""
    wanted = _wanted(query)
    found = _of_terms(index.postings, wanted)
    scored = [(c.field, c.term) for c in query.clauses if c.kind not in (MUST_NOT, PHRASE)]
    df = {(r.field, r.term): r.df for r in _of_terms(index.terms, scored).select("field", "term", "df").collect()} if scored else {}
    stats = index.statistics(n_rows) if df else Statistics()
    in_phrases = {(c.field, t) for c in query.clauses if c.kind == PHRASE for t in c.terms}
    columns = []
    for i, (f, t) in enumerate(wanted):
        here = (F.col("field") == f) & (F.col("term") == t)
        part = F.struct("freq", "length", "boost", *(["positions"] if (f, t) in in_phrases else []))
        columns.append(F.max(F.when(here, part)).alias(f"p_{i}"))
    docs = found.groupBy("doc_id").agg(*columns)
    at = {key: F.col(f"p_{i}") for i, key in enumerate(wanted)}

    def holds(clause: Clause) -> Column:
        parts = [at[clause.field, t] for t in clause.terms]
        present = all_of([p.isNotNull() for p in parts]) if parts else F.lit(False)
        return present & _consecutive([p["positions"] for p in parts]) if clause.kind == PHRASE and parts else present

    by_kind = {kind: [holds(c) for c in query.clauses if c.kind == kind] for kind in (MUST, SHOULD, MUST_NOT, PHRASE)}
    rule = all_of(by_kind[MUST] + by_kind[PHRASE] + [~x for x in by_kind[MUST_NOT]])
    if by_kind[SHOULD] and not by_kind[MUST]:
        rule = rule & any_of(by_kind[SHOULD])
    score, terms = F.lit(0.0), []
    for c in query.clauses:
        if c.kind in (MUST_NOT, PHRASE) or (c.field, c.term) not in df:
            continue
        p = at[c.field, c.term]
        part = idf(F.lit(float(stats.n)), F.lit(float(df[c.field, c.term]))) * bm25.tf(p["freq"], p["length"], F.lit(float(stats.average[c.field]))) * p["boost"]
        score = score + F.coalesce(part, F.lit(0.0))
        terms.append(F.when(p.isNotNull(), F.lit(c.term)))
    found_terms = F.array_compact(F.array(*terms)) if terms else F.array().cast("array<string>")
    return docs.where(rule).select("doc_id", score.alias("score"), found_terms.alias("terms"))


#: Terms that an expansion looks up by value; more are joined.
LOOKUP_TERMS = 2000


def expand_postings(index: StoredIndex, field: str, test: Column, top_k: int, bm25: Bm25, n_rows: int | None = None) -> DataFrame:
    """``doc_id, score``: the best BM25 score of any term of a field that passes a test on ``term``."""
    here = F.col("field") == field
    matched = index.terms.where(here & test).select("term", "df")
    few = matched.limit(LOOKUP_TERMS + 1).collect()
    found = index.postings.where(here)
    if len(few) <= LOOKUP_TERMS:
        found = found.where(F.col("term").isin(*[r.term for r in few]) if few else F.lit(False))
        matched = F.broadcast(index.terms.sparkSession.createDataFrame([(r.term, r.df) for r in few], "term string, df bigint"))
    stats = index.statistics(n_rows)
    part = idf(F.lit(float(stats.n)), F.col("df")) * bm25.tf(F.col("freq"), F.col("length"), F.lit(float(stats.average.get(field) or 0.0))) * F.col("boost")
    hits = found.join(matched, "term").groupBy("doc_id").agg(F.max(part).alias("score")).orderBy(F.desc("score"), "doc_id")
    return hits.limit(top_k) if top_k > 0 else hits


def prefix_postings(index: StoredIndex, field: str, start: str) -> DataFrame:
    """``doc_id, score`` of the documents with a term that starts so, unranked: score 0, by id."""
    found = index.postings.where((F.col("field") == field) & F.col("term").startswith(start))
    return found.select("doc_id").distinct().select("doc_id", F.lit(0.0).alias("score")).orderBy("doc_id")

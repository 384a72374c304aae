"""Ranked boolean search: BM25 scores, sorting, paging and highlights.

A query is one narrow pass over the corpus: which clauses hold, how often their
terms occur and whether the filters pass are all computed within a row, so no
step shuffles until the top rows are taken.  The few statistics that BM25 needs
(documents, average lengths, document frequencies of the query's own terms) come
from one aggregation whose result has one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Bm25, idf
from ..functions.text import Analyzer, has_term, term_frequency
from ..functions.values import parse_float
from ..plans.mapping import BOOLEAN, NUMERIC, TEXT, Schema
from ..plans.query import MUST, MUST_NOT, PHRASE, SHOULD, Query
from . import filters
from .highlight import highlights
from .index import indexed_fields, measured_fields, settled

ASC, DESC = "asc", "desc"


@dataclass(frozen=True)
class Sort:
    field: str
    order: str = ASC


@dataclass(frozen=True)
class Cursor:
    """Where a sorted page ended."""

    sort_value: str | None
    doc_id: object


@dataclass(frozen=True)
class SearchOptions:
    """How to order, cut and mark up the hits; size 0 is no limit."""

    sort: tuple[Sort, ...] = ()
    from_: int = 0
    size: int = 0
    search_after: Cursor | None = None
    highlight: bool = False
    markers: tuple[str, str] = ("<em>", "</em>")


def sort_by(field: str, order: str = ASC) -> SearchOptions:
    """Options that sort by one field."""
    return SearchOptions(sort=(Sort(field, order),))


@dataclass
class SearchResult:
    """Hits in order, and the cursor after them."""

    hits: DataFrame
    sorted_by: str | None = None

    def next_cursor(self) -> Cursor | None:
        """Cursor of the last hit of a sorted page; None if unsorted or empty."""
        if self.sorted_by is None:
            return None
        rows = self.hits.select("doc_id", F.col("fields").getItem(self.sorted_by).alias("value")).tail(1)
        return Cursor(rows[0].value, rows[0].doc_id) if rows else None


@dataclass
class Statistics:
    """What BM25 knows of the corpus, for one query."""

    n: int = 0
    average: dict[str, float] = field(default_factory=dict)
    df: dict[tuple[str, str], int] = field(default_factory=dict)


@dataclass
class Totals:
    """What has been learnt of one version of a corpus: counts, average lengths, document frequencies."""

    rows: int | None = None
    instances: int | None = None
    average: dict[str, float] = field(default_factory=dict)
    df: dict[tuple[str, str], int] = field(default_factory=dict)


def statistics(corpus: DataFrame, wanted: list[tuple[str, str]], n_mode: str, measure: tuple[str, ...] = (), totals: Totals | None = None) -> Statistics:
    """Corpus size, and of the wanted terms document frequencies and their fields' average lengths, in one pass.

    ``measure`` names further fields whose average length is asked for.  What
    ``totals`` has is not computed again, and what is computed is added there; the
    pass reads the columns of what is missing alone, and none is made if nothing is.

    ``n_mode`` "field_instances" counts every indexed value as a document, "documents"
    counts rows.
    """
    totals = Totals() if totals is None else totals
    indexed = set(indexed_fields(corpus))
    wanted = [w for w in dict.fromkeys(wanted) if w[0] in indexed]
    fields = [f for f in dict.fromkeys([*(f for f, _ in wanted), *measure]) if f in measured_fields(corpus)]
    new_fields, new_terms = [f for f in fields if f not in totals.average], [w for w in wanted if w not in totals.df]
    asked = [F.avg(f"l_{f}").alias(f"a_{f}") for f in new_fields]
    asked += [F.count_if(has_term(F.col(f"t_{f}"), t)).alias(f"d_{i}") for i, (f, t) in enumerate(new_terms)]
    if n_mode == "field_instances" and totals.instances is None:
        asked += [F.count(f"v_{f}").alias(f"n_{f}") for f in sorted(indexed)]
    if n_mode != "field_instances" and totals.rows is None:
        asked.append(F.count(F.lit(1)).alias("n"))
    if asked:
        row = settled(corpus, [*new_fields, *(f for f, _ in new_terms)]).agg(*asked).first()
        totals.average |= {f: row[f"a_{f}"] or 0.0 for f in new_fields}
        totals.df |= {w: row[f"d_{i}"] for i, w in enumerate(new_terms)}
        if n_mode == "field_instances" and totals.instances is None:
            totals.instances = sum(row[f"n_{f}"] for f in indexed)
        if n_mode != "field_instances" and totals.rows is None:
            totals.rows = row["n"]
    n = totals.instances if n_mode == "field_instances" else totals.rows
    return Statistics(n or 0, {f: totals.average[f] for f in fields}, {w: totals.df[w] for w in wanted})


def score(corpus: DataFrame, query: Query, stats: Statistics, bm25: Bm25) -> Column:
    """Sum over the must and should clauses of the BM25 score of their terms; repeated clauses count again."""
    total = F.lit(0.0)
    for clause in query.clauses:
        key = (clause.field, clause.term)
        if clause.kind in (MUST_NOT, PHRASE) or not stats.df.get(key):
            continue
        f = clause.field
        tf = bm25.tf(term_frequency(F.col(f"t_{f}"), clause.term), F.col(f"l_{f}"), F.lit(float(stats.average[f])))
        part = idf(F.lit(float(stats.n)), F.lit(float(stats.df[key]))) * tf * F.col(f"b_{f}")
        total = total + F.when(F.col(f"t_{f}").isNotNull(), part).otherwise(0.0)
    return total


def stored_fields(corpus: DataFrame, schema: Schema) -> list[str]:
    return [c[2:] for c in corpus.columns if c.startswith("v_") and schema[c[2:]].store]


def stored_map(corpus: DataFrame, schema: Schema) -> Column:
    """Stored values by field; absent ones are left out."""
    names = stored_fields(corpus, schema)
    if not names:
        return F.lit(None).cast("map<string,string>")
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(f"v_{n}").alias("value")) for n in names))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def sort_key(corpus: DataFrame, schema: Schema, name: str) -> Column:
    """A column that orders a field: by number if it is one, else by bytes."""
    if f"v_{name}" not in corpus.columns:
        return F.lit(None).cast("string")
    mapping = schema[name]
    if mapping.type in NUMERIC and mapping.type != BOOLEAN:
        return F.col(f"n_{name}") if mapping.index else parse_float(F.col(f"v_{name}"))
    return F.col(f"v_{name}")


def match_rows(corpus: DataFrame, schema: Schema, query: Query, bm25: Bm25, n_mode: str, totals: Totals | None = None, scored: bool = True) -> DataFrame:
    """Rows of the corpus that match, with ``score`` and the matched terms.

    A query without clauses matches by its ranges alone, and nothing without any.
    Statistics are gathered only if a score is asked for that depends on them.
    """
    if not query.clauses:
        rule = filters.passes(corpus, schema, query) if query.ranges else F.lit(False)
        return corpus.where(rule).withColumns({"score": F.lit(0.0), "terms": F.array().cast("array<string>")})
    wanted = [(c.field, c.term) for c in query.clauses if c.kind not in (MUST_NOT, PHRASE)]
    stats = statistics(corpus, wanted, n_mode, totals=totals) if scored and wanted else Statistics()
    corpus = settled(corpus, [c.field for c in query.clauses])
    found = [F.when(filters.holds(corpus, c), F.lit(c.term)) for c in query.clauses if c.kind in (MUST, SHOULD)]
    rows = corpus.where(filters.passes(corpus, schema, query) & filters.matches(corpus, query))
    return rows.withColumns({"score": score(corpus, query, stats, bm25), "terms": F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")})


def search(
    corpus: DataFrame,
    schema: Schema,
    query: Query,
    top_k: int = 0,
    options: SearchOptions = SearchOptions(),
    bm25: Bm25 = Bm25(),
    analyzer: Analyzer = Analyzer(),
    n_mode: str = "field_instances",
    totals: Totals | None = None,
) -> SearchResult:
    """Hits ``doc_id, fields, score, highlights``, best first, or by the sort fields."""
    return present(match_rows(corpus, schema, query, bm25, n_mode, totals), corpus, schema, top_k, options, analyzer)


def present(rows: DataFrame, corpus: DataFrame, schema: Schema, top_k: int, options: SearchOptions, analyzer: Analyzer) -> SearchResult:
    """Order, cut and mark up matching rows of a corpus that have ``score`` and ``terms``.

    Ties: the better score, then the smaller id.  Missing sort values come last.
    The page is cut by cursor or offset, then by size, then by ``top_k``.
    """
    keys = [(f"k_{i}", s.order) for i, s in enumerate(options.sort)]
    rows = rows.withColumns({k: sort_key(corpus, schema, s.field) for (k, _), s in zip(keys, options.sort)}) if keys else rows
    order = [F.col(k).desc_nulls_last() if o == DESC else F.col(k).asc_nulls_last() for k, o in keys]
    order += [F.col("score").desc(), F.col("doc_id").asc()]
    if options.search_after is not None:
        rows = _after(rows, keys, options.search_after.doc_id)
    page = rows.orderBy(*order)
    limits = [x for x in (options.size, top_k) if x > 0]
    if options.from_ > 0 and options.search_after is None:
        page = page.offset(options.from_)
    if limits:
        page = page.limit(min(limits))
    marks = F.array().cast("array<struct<field:string,snippet:string>>")
    if options.highlight:
        shown = [f for f in stored_fields(corpus, schema) if schema[f].type == TEXT]
        marks = highlights(shown, F.col("terms"), analyzer, *options.markers)
    hits = page.select("doc_id", stored_map(corpus, schema).alias("fields"), "score", marks.alias("highlights"))
    return SearchResult(hits, options.sort[0].field if options.sort else None)


def _after(rows: DataFrame, keys: list[tuple[str, str]], doc_id: object) -> DataFrame:
    """Rows that come strictly after the cursor's row; none if it is not among them."""
    at = rows.where(F.col("doc_id") == F.lit(doc_id)).select("doc_id", "score", *(k for k, _ in keys)).first()
    if at is None:
        return rows.where(F.lit(False))
    later, equal = F.lit(False), F.lit(True)
    for k, order in [*keys, ("score", DESC), ("doc_id", ASC)]:
        value = at[k]
        if value is None:
            beyond = F.lit(False)
        else:
            beyond = (F.col(k) < F.lit(value) if order == DESC else F.col(k) > F.lit(value)) | F.col(k).isNull()
        later = later | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & F.col(k).eqNullSafe(F.lit(value))
    return rows.where(later)

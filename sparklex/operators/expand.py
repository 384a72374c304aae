"""Term expansion: fuzzy, wildcard and prefix search over one field.

Terms are tested as they are read, before anything is shuffled; only those that
match are counted, and joined with their document frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Bm25, idf, wildcard_regex, within_distance
from ..functions.text import has_prefix, term_frequency
from .index import settled
from .search import Totals, statistics


def _matched(corpus: DataFrame, field: str, test: Column) -> DataFrame:
    """``doc_id, term, freq, length, boost`` of each term of the field that passes a test on ``term``."""
    return (
        settled(corpus, [field])
        .select("doc_id", f"t_{field}", f"l_{field}", f"b_{field}", F.explode(F.array_distinct(f"t_{field}")).alias("term"))
        .where(test)
        .select("doc_id", "term", term_frequency(F.col(f"t_{field}"), F.col("term")).alias("freq"), F.col(f"l_{field}").alias("length"), F.col(f"b_{field}").alias("boost"))
    )


def _nothing(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))


def expand(corpus: DataFrame, field: str, test: Column, top_k: int, bm25: Bm25, n_mode: str, totals: Totals | None = None) -> DataFrame:
    """``doc_id, score``: the best BM25 score of any matching term, each with its own document frequency."""
    if f"t_{field}" not in corpus.columns:
        return _nothing(corpus)
    stats = statistics(corpus, [], n_mode, (field,), totals)
    found = _matched(corpus, field, test)
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = idf(F.lit(float(stats.n)), F.col("df")) * bm25.tf(F.col("freq"), F.col("length"), F.lit(float(stats.average[field]))) * F.col("boost")
    hits = found.join(df, "term").groupBy("doc_id").agg(F.max(part).alias("score")).orderBy(F.desc("score"), "doc_id")
    return hits.limit(top_k) if top_k > 0 else hits


def fuzzy_test(term: str, distance: int) -> Column:
    """True for a ``term`` within a byte edit distance."""
    return within_distance(F.col("term"), term, distance)


def wildcard_test(pattern: str) -> Column:
    """True for a ``term`` that a pattern of ``*`` and ``?`` covers whole; what stands before them is a range of terms."""
    start = pattern[: min([pattern.index(c) for c in "*?" if c in pattern], default=len(pattern))]
    test = F.col("term").rlike(wildcard_regex(pattern))
    return F.col("term").startswith(start) & test if start else test


def fuzzy(corpus: DataFrame, field: str, term: str, distance: int, top_k: int = 0, bm25: Bm25 = Bm25(), n_mode: str = "field_instances", totals: Totals | None = None) -> DataFrame:
    """Terms within a byte edit distance."""
    return expand(corpus, field, fuzzy_test(term, distance), top_k, bm25, n_mode, totals)


def wildcard(corpus: DataFrame, field: str, pattern: str, top_k: int = 0, bm25: Bm25 = Bm25(), n_mode: str = "field_instances", totals: Totals | None = None) -> DataFrame:
    """Terms that a pattern of ``*`` and ``?`` covers whole."""
    return expand(corpus, field, wildcard_test(pattern), top_k, bm25, n_mode, totals)


def prefix(corpus: DataFrame, field: str, start: str) -> DataFrame:
    """Documents with a term that starts so, unranked: score 0, by id."""
    if f"t_{field}" not in corpus.columns:
        return _nothing(corpus)
    return settled(corpus, [field]).where(has_prefix(F.col(f"t_{field}"), start)).select("doc_id", F.lit(0.0).alias("score")).orderBy("doc_id")


def completions(corpus: DataFrame, field: str, start: str) -> DataFrame:
    """Distinct terms of a field that start so."""
    terms = corpus.select(F.explode(F.array_distinct(f"t_{field}")).alias("term"))
    return terms.where(F.col("term").startswith(start)).distinct().orderBy("term")

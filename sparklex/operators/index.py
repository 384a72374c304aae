"""The analysed form of documents, and the inverted index derived from it.

A corpus is one wide DataFrame.  For a field ``f`` it has ``v_f`` (the raw value
as a string), and as the mapping asks ``t_f`` (terms by position), ``l_f`` (token
count), ``b_f`` (boost), ``r_f`` (the one term of a field that is not text), ``n_f``
(number) and ``x_f`` (vector).  All of it is a
projection of the input: nothing is shuffled to make documents searchable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import Analyzer, token_count
from ..functions.values import parse_boolean, parse_float, parse_integer
from ..plans.mapping import BOOLEAN, FLOAT, INTEGER, NUMERIC, SKIP, TEXT, VECTOR, FieldMapping, Schema


def analyse(df: DataFrame, id_col: str, schema: Schema, analyzer: Analyzer) -> DataFrame:
    """The wide analysed form of ``df`` under a schema; absent values are NULL."""
    fields = [(n, m) for n, m in sorted(schema.items()) if m.type != SKIP and n in df.columns]
    plain = [c for n, m in fields for c in _plain_columns(n, m, df.schema[n].dataType)]
    rows = df.select(F.col(id_col).alias("doc_id"), *plain)
    texts = {f"t_{n}": F.when(F.col(f"v_{n}").isNotNull(), analyzer(F.col(f"v_{n}"))) for n, m in fields if m.type == TEXT and m.index}
    rows = rows.withColumns(texts) if texts else rows
    lengths = {}
    for n, m in fields:
        if m.type != VECTOR:
            tokens = F.col(f"t_{n}") if f"t_{n}" in texts else analyzer(F.col(f"v_{n}"))
            lengths[f"l_{n}"] = F.when(F.col(f"v_{n}").isNotNull(), token_count(tokens))
    return rows.withColumns(lengths) if lengths else rows


def settled(corpus: DataFrame, fields: list[str]) -> DataFrame:
    """The corpus with the texts of some fields analysed once for each row.

    Their tokens come out of a generator of one row, below which the optimizer
    moves no predicate on them, and so does not repeat the analysis in each.
    Predicates on values and numbers do move down, into the scan.  The outer form
    keeps the optimizer from testing the generator's input, which is never empty.
    """
    texts = [f for f in dict.fromkeys(fields) if f"t_{f}" in corpus.columns and f"r_{f}" not in corpus.columns]
    if not texts:
        return corpus
    kept = [c for c in corpus.columns if c[2:] not in texts or c[:2] not in ("t_", "l_")]
    rows = corpus.select(*kept, F.explode_outer(F.array(F.struct(*(f"t_{f}" for f in texts)))).alias("__analysed")).select(*kept, "__analysed.*")
    return rows.withColumns({f"l_{f}": F.when(F.col(f"v_{f}").isNotNull(), token_count(F.col(f"t_{f}"))) for f in texts})


def _plain_columns(name: str, mapping: FieldMapping, kind: T.DataType) -> list[Column]:
    if mapping.type == VECTOR:
        return [F.col(name).cast("array<double>").alias(f"x_{name}")]
    value = F.col(name).cast("string")
    boost = F.lit(mapping.boost) if mapping.boost_column is None else F.col(mapping.boost_column).cast("double")
    out = [value.alias(f"v_{name}"), F.coalesce(boost, F.lit(1.0)).alias(f"b_{name}")]
    if mapping.index and mapping.type != TEXT:
        out += [value.alias(f"r_{name}"), F.when(value.isNotNull(), F.array(value)).alias(f"t_{name}")]
    if mapping.index and mapping.type in NUMERIC:
        parse = {INTEGER: parse_integer, BOOLEAN: parse_boolean}.get(mapping.type, parse_float)
        if isinstance(kind, T.IntegralType) and mapping.type != BOOLEAN:
            number = F.col(name).cast("bigint")  # as it is stored, so that its bounds reach the scan
        elif isinstance(kind, T.NumericType) and mapping.type == FLOAT:
            number = F.col(name).cast("double")
        else:
            number = parse(value).cast("double")
        out.append(number.alias(f"n_{name}"))
    return out


def indexed_fields(corpus: DataFrame) -> list[str]:
    return [c[2:] for c in corpus.columns if c.startswith("t_")]


def measured_fields(corpus: DataFrame) -> list[str]:
    return [c[2:] for c in corpus.columns if c.startswith("l_")]


def _occurrences(tokens: Column) -> Column:
    """``array<struct<term, positions>>`` of the distinct terms of a token array, by one sort of its elements.

    Each step is bound by a lambda, so that it is computed once for each row.
    """
    pairs = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda p: p["term"].isNotNull())

    def grouped(run: Column) -> Column:
        begins = F.filter(_upto(F.size(run)), lambda i: (i == 0) | (F.get(run, i)["term"] != F.get(run, i - 1)["term"]))

        def cut(starts: Column) -> Column:
            def one(start: Column, j: Column) -> Column:
                end = F.coalesce(F.get(starts, j + 1), F.size(run))
                return F.struct(F.get(run, start)["term"].alias("term"), F.transform(F.slice(run, start + 1, end - start), lambda p: p["pos"]).alias("positions"))

            return F.transform(starts, one)

        return F.get(F.transform(F.array(begins), cut), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(pairs)), grouped), F.lit(0))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def postings(corpus: DataFrame) -> DataFrame:
    """``field, term, doc_id, freq, positions, length, boost``: the inverted index.

    A document's tokens lie in one row, and so do the postings they make: they are
    grouped there, and nothing is shuffled.
    """
    parts, corpus = None, settled(corpus, indexed_fields(corpus))
    for f in indexed_fields(corpus):
        rows = corpus.where(F.col(f"v_{f}").isNotNull())
        head = ["doc_id", F.lit(f).alias("field"), F.col(f"l_{f}").alias("length"), F.col(f"b_{f}").alias("boost")]
        if f"r_{f}" in corpus.columns:
            part = rows.select(*head, F.struct(F.col(f"r_{f}").alias("term"), F.array(F.lit(0)).alias("positions")).alias("p"))
        else:
            part = rows.select(*head, F.explode(_occurrences(F.col(f"t_{f}"))).alias("p"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("no field is indexed")
    return parts.select("field", "p.term", "doc_id", F.size("p.positions").cast("long").alias("freq"), "p.positions", "length", "boost")


def term_dictionary(corpus: DataFrame) -> DataFrame:
    """``field, term, df``: every term and the number of documents that hold it."""
    parts = None
    for f in indexed_fields(corpus):
        part = corpus.select(F.lit(f).alias("field"), F.explode(F.array_distinct(f"t_{f}")).alias("term")).where(F.col("term").isNotNull())
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(corpus: DataFrame) -> DataFrame:
    """``doc_id, field, length`` of every value, in tokens."""
    fields = measured_fields(corpus)
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("length")) for f in fields)))
    return corpus.select("doc_id", pairs.alias("p")).where(F.col("p.length").isNotNull()).select("doc_id", "p.field", "p.length")


def field_stats(corpus: DataFrame) -> DataFrame:
    """``field, n_docs, avg_length``."""
    return doc_lengths(corpus).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))


def numeric_points(corpus: DataFrame) -> DataFrame:
    """``doc_id, field, value`` of every indexed number."""
    fields = [c[2:] for c in corpus.columns if c.startswith("n_")]
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").cast("double").alias("value")) for f in fields)))
    return corpus.select("doc_id", pairs.alias("p")).where(F.col("p.value").isNotNull()).select("doc_id", "p.field", "p.value")

"""Exact vector search by cosine, and its blend with ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import cosine


def vector_search(corpus: DataFrame, field: str, vector: list[float], top_k: int = 0) -> DataFrame:
    """``doc_id, score`` of vectors with a positive cosine to the query's, best first."""
    if f"x_{field}" not in corpus.columns:
        return corpus.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    target = F.array(*(F.lit(float(x)) for x in vector)) if vector else F.array().cast("array<double>")
    hits = corpus.where(F.col(f"x_{field}").isNotNull()).select("doc_id", cosine(F.col(f"x_{field}"), target).alias("score"))
    hits = hits.where("score > 0").orderBy(F.desc("score"), "doc_id")
    return hits.limit(top_k) if top_k > 0 else hits


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, alpha: float, top_k: int = 0) -> DataFrame:
    """``doc_id, score``: alpha times the text score plus the rest times the cosine, where positive.

    A side that misses a document counts 0 for it.
    """
    text = text_hits.select("doc_id", F.col("score").alias("text_score"))
    vectors = vector_hits.select("doc_id", F.col("score").alias("vector_score"))
    blend = F.lit(float(alpha)) * F.coalesce("text_score", F.lit(0.0)) + F.lit(1.0 - alpha) * F.coalesce("vector_score", F.lit(0.0))
    hits = text.join(vectors, "doc_id", "full_outer").select("doc_id", blend.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id")
    return hits.limit(top_k) if top_k > 0 else hits

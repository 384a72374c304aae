"""Facet counts and metrics over matching documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import parse_float


def terms_aggregation(rows: DataFrame, field: str, top_k: int = 0) -> DataFrame:
    """``key, count`` of a field's raw values, most frequent first, then by key; missing values are skipped."""
    if f"v_{field}" not in rows.columns:
        return rows.where(F.lit(False)).select(F.lit("").alias("key"), F.lit(0).cast("long").alias("count"))
    counts = (
        rows.where(F.col(f"v_{field}").isNotNull())
        .groupBy(F.col(f"v_{field}").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "key")
    )
    return counts.limit(top_k) if top_k > 0 else counts


def metrics(rows: DataFrame, field: str) -> DataFrame:
    """One row ``count, sum, avg, min, max`` over the values that are numbers; zeros if there are none."""
    value = parse_float(F.col(f"v_{field}")) if f"v_{field}" in rows.columns else F.lit(None).cast("double")
    numbers = rows.select(F.when(~F.isnan(value), value).alias("x"))
    zero = F.lit(0.0)
    return numbers.agg(
        F.count("x").alias("count"),
        *(F.coalesce(f("x"), zero).alias(name) for name, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))),
    )

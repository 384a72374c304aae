"""The corpus operators as registered queries over the standard tables.

Each query applies one operator with its production parameters to its whole
table.  ``ORACLES`` holds the same result in DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, licenses, line_dedup, media, near_duplicates, quality, secrets, url_filter
from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"), report=True)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out())
    return language_id.predict(docs, model).withColumn("held_out", language_id.held_out())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_features(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "rate_low", "rate_toxic", "p_bad", "accepted")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_secrets": op3_secrets,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
}

"""A corpus pipeline: five stages, each one of the corpus operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the last
keep the columns of ``documents``, and any others, under whatever names.

Defined cases, in every stage: a null or empty text is a document without words or
lines, is never a copy of another, shares nothing with the benchmark, and is judged
by the classifier from its shape; an empty one is a copy of other empty ones.
Null ids, labels, hosts and languages are values like others, and a null item id of the benchmark still
matches.  Rows repeated with the same id and text are judged alike; the near-duplicate
stage keeps one of them.  Rows that share an id but not the text are documents of their own.
Ties go to the smaller id, then the smaller digest of the text; a probability right at the threshold is
accepted; a pair right at the threshold is linked.  Texts of any length are read
whole.  An empty table gives an empty one; without labels or benchmark items no
document goes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.llm import bpe, decontaminate, line_dedup, near_duplicates, quality
from sparklex.llm.common import delete_folder, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject as low in quality or toxic."""
    return quality.accepted(quality.judge(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; ``n_chars`` follows the text where there is one.

    Passages that only two documents hold stay: of two copies the next stage drops one whole, which it could not
    recognise if this one had taken its lines.
    """
    kept = line_dedup.dedup(docs, passage_docs=line_dedup.MIN_DOCS)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL expresses neither the fitted classifier nor the BPE merges; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared checkpoint folder.

    A stage's table is deleted once the next one is written; the last one stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

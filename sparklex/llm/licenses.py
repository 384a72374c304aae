"""Licence scans by canonical digests, with DataFrame functions alone.

A text is brought to a canonical form: lower case; punctuation and blanks turned
into single blanks; spellings that mean the same made equal; lines that state a
copyright left out.  The SHA-256 digest of the whole canonical text, its lines
joined, is hash-joined to the digests of known licences, so how its paragraphs are
wrapped does not matter; that of each canonical line is joined to those of known one-line
notices.

The catalogue, texts of short licences and digests of long ones, is part of the
program, so its broadcast has a fixed bound.

Defined cases: a null or empty text has no licence and no notice; a notice that
repeats in a text counts each time but is listed once; repeated rows each give a
row; only the id and text columns are read, whatever the names of others; a text
known under several names has the first by name; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, row_key
from .license_catalog import CATALOG, DIGESTS, SPELLINGS

_BETWEEN_WORDS = r"[^\p{L}\p{N}\n©]+"
#: Canonical lines that state a copyright: with a year or a sign, or at the head of a text any that begin so.
COPYRIGHT = r"^(©|(copyright|c)( c| ©| by)* ([0-9]{4}|year|yyyy)( |$)|copyright (c|©)( |$)|all rights reserved$)"
HEAD = r"^copyright( |$)"
HEAD_LINES = 3
SEVERAL_WORDS = (*(pair for pair in SPELLINGS if " " in pair[0].strip()), (" all rights reserved", ""))


def _spelled(text: Column, among: tuple[tuple[str, str], ...] = SPELLINGS) -> Column:
    for variant, spelling in among:
        text = F.replace(text, F.lit(variant), F.lit(spelling))
    return text


def canonical_text(lines: Column) -> Column:
    """Canonical lines as one; variants of several words may have stood on two lines."""
    return _spelled(F.array_join(lines, " "), SEVERAL_WORDS)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty ones and those that state a copyright."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN_WORDS, " ")
    lines = F.array_remove(F.transform(F.split(_spelled(out), "\n"), lambda line: F.trim(line)), "")
    return F.filter(lines, lambda line, i: ~line.rlike(COPYRIGHT) & ~((i < HEAD_LINES) & line.rlike(HEAD)))


def known(spark, catalog: tuple[tuple[str, str, str], ...] = CATALOG, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """Digests of the catalogue: ``unit, digest, license``."""
    rows = spark.createDataFrame(list(catalog), "license string, unit string, text string")
    rows = rows.select("license", "unit", F.sha2(canonical_text(canonical_lines(F.col("text"))), 256).alias("digest"))
    long = spark.createDataFrame(list(digests), "license string, digest string").select("license", F.lit("text").alias("unit"), "digest")
    return rows.unionByName(long).groupBy("unit", "digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: tuple[tuple[str, str, str], ...] = CATALOG, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """``doc_id, license, notices, n_notice_lines`` of every row.

    ``license`` is that whose text the row is; ``notices`` lists the licences
    named by its lines, sorted and comma-joined.
    """
    units = id_and_text(docs, id_col, text_col).select(*row_key("doc_id", "text"), "doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.sha2(canonical_text(F.col("lines")), 256).alias("digest")))
    each = F.transform("lines", lambda line: F.struct(F.lit("notice").alias("unit"), F.sha2(line, 256).alias("digest")))
    spread = units.select("key_id", "key_text", "doc_id", F.explode(F.concat(whole, each)).alias("u"))
    table = F.broadcast(known(docs.sparkSession, catalog, digests).withColumnsRenamed({"unit": "k_unit", "digest": "k_digest"}))
    found = spread.join(table, (F.col("u.unit") == F.col("k_unit")) & (F.col("u.digest") == F.col("k_digest")), "left").where(
        F.col("license").isNotNull() | (F.col("u.unit") == "text")
    )
    is_text, is_notice = F.col("u.unit") == "text", F.col("u.unit") == "notice"
    merged = found.groupBy("key_id", "key_text", "doc_id").agg(
        F.max(F.when(is_text, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_notice, F.col("license")))), ",").alias("notices"),
        F.count(F.when(is_text, 1)).cast("int").alias("rows"),
        F.count(F.when(is_notice, 1)).alias("lines"),
    )
    return merged.select(
        "doc_id", "license", "notices", F.expr("lines div rows").alias("n_notice_lines"), F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("row")
    ).drop("row")

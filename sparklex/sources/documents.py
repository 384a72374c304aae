"""Documents as data: JSON codec, records from dataclasses, upserts and deletes."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.mapping import FieldMapping

#: A field of a document in its map form.
FIELD_TYPE = "struct<value:string,boost:double,vector:array<double>>"
DOCUMENT_TYPE = f"struct<id:string,fields:map<string,{FIELD_TYPE}>>"


def to_json(df: DataFrame, id_col: str, fields: list[str], vectors: tuple[str, ...] = (), boosts: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, json``: every row as a document ``{id, fields: {name: {value, boost, vector}}}``."""
    boosts = boosts or {}
    entries = []
    for name in fields:
        vector = F.col(name).cast("array<double>") if name in vectors else F.lit(None).cast("array<double>")
        value = F.lit(None).cast("string") if name in vectors else F.col(name).cast("string")
        body = F.struct(value.alias("value"), F.lit(float(boosts.get(name, 1.0))).alias("boost"), vector.alias("vector"))
        entries.append(F.struct(F.lit(name).alias("key"), F.when(F.col(name).isNotNull(), body).alias("value")))
    present = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    doc = F.struct(F.col(id_col).cast("string").alias("id"), F.map_from_entries(present).alias("fields"))
    return df.select(F.col(id_col).alias("doc_id"), F.to_json(doc).alias("json"))


def from_json(df: DataFrame, json_col: str, fields: list[str], vectors: tuple[str, ...] = ()) -> DataFrame:
    """Wide rows ``doc_id, <fields>, boost_<fields>`` of JSON documents; malformed ones are dropped."""
    doc = F.from_json(F.col(json_col), DOCUMENT_TYPE)
    rows = df.select(doc.alias("d")).where(F.col("d.id").isNotNull())
    columns = [F.col("d.id").alias("doc_id")]
    for name in fields:
        field = F.col("d.fields").getItem(name)
        columns.append(field["vector"].alias(name) if name in vectors else field["value"].alias(name))
        columns.append(field["boost"].alias(f"boost_{name}"))
    return rows.select(*columns)


def field_names(df: DataFrame, json_col: str) -> dict[str, bool]:
    """The fields of JSON documents, and whether they are vectors."""
    pairs = df.select(F.explode(F.from_json(F.col(json_col), DOCUMENT_TYPE)["fields"]).alias("name", "field"))
    rows = pairs.groupBy("name").agg(F.max(F.col("field.vector").isNotNull()).alias("is_vector")).collect()
    return {r.name: r.is_vector for r in rows}


def search_field(name: str = "", boost: float = 1.0, is_id: bool = False, **options):
    """A dataclass field that is searched under a name with a boost, or is the id."""
    return dataclasses.field(metadata={"search": {"name": name, "boost": boost, "id": is_id}}, **options)


def from_records(spark: SparkSession, records: list) -> tuple[DataFrame, dict[str, FieldMapping | float]]:
    """A DataFrame ``doc_id, <fields>`` of dataclass instances, and the boost of each field.

    Exactly the fields made by :func:`search_field` are taken; empty values count
    as absent.  The id and all fields must be strings.
    """
    if not records:
        raise ValueError("no records")
    kind = type(records[0])
    if not dataclasses.is_dataclass(kind):
        raise TypeError(f"{kind.__name__} is not a dataclass")
    tagged = {f.name: f.metadata["search"] for f in dataclasses.fields(kind) if "search" in f.metadata}
    ids = [n for n, tag in tagged.items() if tag["id"]]
    if len(ids) != 1:
        raise ValueError(f"{kind.__name__} needs exactly one id field")
    names = {n: tag["name"] or n for n, tag in tagged.items() if not tag["id"]}
    boosts = {names[n]: float(tag["boost"]) for n, tag in tagged.items() if not tag["id"]}
    rows = []
    for record in records:
        if type(record) is not kind:
            raise TypeError("records are of different types")
        values = [getattr(record, n) for n in (ids[0], *names)]
        if any(not isinstance(v, str) for v in values):
            raise TypeError(f"fields of {kind.__name__} must be strings")
        if not values[0]:
            raise ValueError("a document's id is empty")
        rows.append((values[0], *(v or None for v in values[1:])))
    schema = ", ".join(f"`{c}` string" for c in ("doc_id", *names.values()))
    return spark.createDataFrame(rows, schema), boosts


def latest(df: DataFrame, key: str, seq: Column | str) -> DataFrame:
    """One row for each key: that of the largest sequence value."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    picked = df.select(F.col(key).alias("__key"), F.struct("*").alias("__row"), seq.alias("__seq")).groupBy("__key")
    return picked.agg(F.max_by("__row", "__seq").alias("__row")).select("__row.*")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each key; rows of a repeated key are told apart by a digest of their content.

    The keys alone are counted first: without repeats ``df`` is returned as it is, else only the repeated rows are merged.
    """
    repeated = df.groupBy(key).count().where(F.col("count") > 1).select(key)
    if not repeated.take(1):
        return df
    merged = latest(df.join(repeated, key, "left_semi"), key, F.sha2(F.to_json(F.struct("*")), 256))
    return df.join(repeated, key, "left_anti").unionByName(merged)


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with the same key."""
    kept = current.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``current`` without the keys given."""
    return current.join(keys.select(key), key, "left_anti")

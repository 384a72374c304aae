"""Field mappings: explicit ones, and types inferred from the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import infer_type

TEXT, KEYWORD, INTEGER, FLOAT, BOOLEAN, SKIP, VECTOR = "text", "keyword", "integer", "float", "boolean", "skip", "vector"
NUMERIC = (INTEGER, FLOAT, BOOLEAN)


class FieldTypeConflict(ValueError):
    """A value cannot be read as its field's mapped type."""


@dataclass(frozen=True)
class FieldMapping:
    """How a field is indexed; ``boost`` multiplies its scores, or ``boost_column`` does, row by row."""

    type: str
    index: bool = True
    store: bool = True
    boost: float = 1.0
    boost_column: str | None = None
    explicit: bool = True


class Schema(dict):
    """Field name to :class:`FieldMapping`."""

    def set(self, name: str, mapping: FieldMapping) -> None:
        self[name] = mapping

    def fields(self) -> dict[str, FieldMapping]:
        return dict(self)

    def table(self, spark) -> DataFrame:
        rows = [(n, m.type, m.index, m.store, m.explicit) for n, m in sorted(self.items())]
        return spark.createDataFrame(rows, "field string, type string, index boolean, store boolean, explicit boolean")


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, types``: the distinct inferred types of each column's values, sorted."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), infer_type(F.col(c).cast("string")).alias("type")) for c in columns)))
    return (
        df.select(pairs.alias("p"))
        .where(F.col("p.type").isNotNull())
        .groupBy("p.field")
        .agg(F.array_sort(F.collect_set("p.type")).alias("types"))
    )


def _by_column_type(kind: T.DataType) -> str | None:
    if isinstance(kind, T.IntegralType):
        return INTEGER
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return KEYWORD
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FractionalType):
        return VECTOR
    return None


def infer_mapping(df: DataFrame, id_col: str, explicit: dict[str, FieldMapping] | None = None, known: Schema | None = None) -> Schema:
    """A mapping for every column but the id.

    Explicit mappings win.  Typed columns keep their type.  A string column has
    the type of its values if they agree, among themselves and with what is known
    of the field, and is text otherwise.  One aggregation over the data; what is
    collected is a few names for each column.
    """
    explicit, known, out = explicit or {}, known or Schema(), Schema()
    open_columns = []
    for f in df.schema.fields:
        if f.name == id_col:
            continue
        by_type = _by_column_type(f.dataType)
        if f.name in explicit:
            out[f.name] = explicit[f.name]
        elif f.name in known and known[f.name].explicit:
            out[f.name] = known[f.name]
        elif by_type:
            out[f.name] = FieldMapping(by_type, explicit=False)
        else:
            open_columns.append(f.name)
    if open_columns:
        for row in inferred_types(df, open_columns).collect():
            types = set(row.types) | ({known[row.field].type} if row.field in known else set())
            out[row.field] = FieldMapping(types.pop() if len(types) == 1 else TEXT, explicit=False)
    for name, mapping in known.items():
        out.setdefault(name, mapping)
    return out

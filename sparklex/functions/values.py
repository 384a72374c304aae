"""Typed views of string values: numbers, booleans, inferred types, sortable codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"(?i)^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?|nan)\z"
_INTEGER = r"^[+-]?[0-9]+\z"
#: Strings that a boolean may be written as.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")


def parse_float(value: Column) -> Column:
    """A double where the whole string is a decimal number in range, else NULL.

    A plain cast is laxer: it takes blanks and type suffixes, and turns an
    overflow into infinity.
    """
    number = F.when(value.rlike(_FLOAT), value.try_cast("double"))
    overflow = number.isin(float("inf"), float("-inf")) & ~value.rlike("(?i)inf")
    return F.when(~overflow | F.isnan(number), number)


def parse_integer(value: Column) -> Column:
    """A bigint where the whole string is a decimal integer in range, else NULL."""
    return F.when(value.rlike(_INTEGER), value.try_cast("bigint"))


def parse_boolean(value: Column) -> Column:
    """1.0 or 0.0 for a boolean word, else NULL."""
    return F.when(value.isin(*TRUE_WORDS), 1.0).when(value.isin(*FALSE_WORDS), 0.0)


def infer_type(value: Column) -> Column:
    """``integer``, ``float``, ``boolean``, ``keyword`` or ``text``; NULL for NULL."""
    short = (F.octet_length(value) < 64) & ~F.contains(value, F.lit(" "))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(parse_integer(value).isNotNull(), "integer")
        .when(parse_float(value).isNotNull(), "float")
        .when(value.isin("true", "false"), "boolean")
        .when(short, "keyword")
        .otherwise("text")
    )


def encode_int64(value: Column) -> Column:
    """16 hex digits that sort as the integers do."""
    return F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def decode_int64(code: Column) -> Column:
    """The integer of :func:`encode_int64`."""
    high, low = (F.conv(F.substring(code, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)))


def _double_bits(value: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value).cast("bigint")


def encode_float64(value: Column) -> Column:
    """16 hex digits that sort as the doubles do: the sign bit is turned round, and for negative numbers all others too."""
    bits = _double_bits(value.cast("double"))
    return F.lpad(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")


def decode_float64(code: Column) -> Column:
    """The double of :func:`encode_float64`."""
    flipped = decode_int64(code)
    bits = F.when(flipped < 0, F.bitwise_not(flipped.bitwiseXOR(F.lit(-(1 << 63))))).otherwise(flipped)
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")

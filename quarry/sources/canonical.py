"""One canonical text for a value, made alike by Spark and by Python.

A record's identity is the SHA-256 of the canonical texts of its identity fields,
so a record has one identity however it is ingested.  Strings carry their length,
so no two different values share a text; doubles are hexadecimal, which is exact;
null differs from everything.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def canonical_column(column: Column, kind: T.DataType) -> Column:
    match kind:
        case T.StringType():
            text = F.concat(F.lit("s"), F.length(column).cast("string"), F.lit(":"), column)
        case T.BooleanType():
            text = F.concat(F.lit("b"), column.cast("string"))
        case T.IntegerType() | T.LongType():
            text = F.concat(F.lit("i"), column.cast("string"))
        case T.DoubleType():
            text = F.when(F.isnan(column), F.lit("dNaN")).otherwise(F.format_string("d%a", column))
            text = F.when(column.isNotNull(), text)
        case T.BinaryType():
            text = F.concat(F.lit("x"), F.hex(column))
        case T.TimestampType():
            text = F.concat(F.lit("t"), F.unix_micros(column).cast("string"))
        case T.ArrayType():
            each = F.transform(column, lambda v: canonical_column(v, kind.elementType))
            text = F.concat(F.lit("["), F.size(column).cast("string"), F.lit(":"), F.array_join(each, ","), F.lit("]"))
            text = F.when(column.isNotNull(), text)
        case _:
            raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.coalesce(text, F.lit("n"))


def hexadecimal(value: float) -> str:
    """A double as Java's formatter writes it by %a."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    digits, _, power = value.hex().partition("p")
    whole, _, part = digits.partition(".")
    return f"{whole}.{part.rstrip('0') or '0'}p{int(power)}"


def canonical_text(value: Any, kind: T.DataType) -> str:
    if value is None:
        return "n"
    match kind:
        case T.StringType():
            return f"s{len(value)}:{value}"
        case T.BooleanType():
            return "btrue" if value else "bfalse"
        case T.IntegerType() | T.LongType():
            return f"i{value}"
        case T.DoubleType():
            return "d" + hexadecimal(float(value))
        case T.BinaryType():
            return "x" + bytes(value).hex().upper()
        case T.TimestampType():
            return f"t{(value.astimezone(UTC) - EPOCH) // timedelta(microseconds=1)}"
        case T.ArrayType():
            return f"[{len(value)}:{','.join(canonical_text(v, kind.elementType) for v in value)}]"
    raise TypeError(f"no canonical text for {kind.simpleString()}")


def identity_column(head: str, cells: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    """Identity of a row: ``head`` names what it is, ``cells`` are its named columns in order."""
    parts = [F.lit(head)]
    for name, column, kind in cells:
        parts += [F.lit(f"|{name}="), canonical_column(column, kind)]
    return F.sha2(F.concat(*parts), 256)


def identity_text(head: str, cells: Sequence[tuple[str, Any, T.DataType]]) -> str:
    body = head + "".join(f"|{name}={canonical_text(value, kind)}" for name, value, kind in cells)
    return hashlib.sha256(body.encode()).hexdigest()

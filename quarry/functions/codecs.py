"""How Python values become columns and come back.

Rationals keep a double for comparison and exact text for equality and
retrieval; the text of p/q is reduced with a positive denominator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from fractions import Fraction
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class ValueCodec:
    """Columns (suffix, type) of a Python type, with encoder and decoder.

    The first column is the one that queries compare; ``query`` encodes an operand for it.
    """

    columns: tuple[tuple[str, T.DataType], ...]
    encode: Callable[[Any], tuple]
    decode: Callable[[tuple], Any]
    query: Callable[[Any], Any]
    exact: str | None = None


def exact_text(value: Any) -> str:
    """Exact text of a rational or of a float (its hexadecimal form keeps -0.0)."""
    if isinstance(value, float):
        return value.hex()
    f = Fraction(value)
    return f"{f.numerator}/{f.denominator}" if f.denominator != 1 else str(f.numerator)


def nearest(value: Fraction) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def utc(value: datetime) -> datetime:
    if value.tzinfo is None:
        raise ValueError("a datetime needs its offset from UTC")
    return value.astimezone(UTC)


FRACTION = ValueCodec(
    (("", T.DoubleType()), ("_exact", T.StringType())),
    lambda v: (nearest(Fraction(v)), exact_text(Fraction(v))),
    lambda cells: Fraction(cells[1]),
    lambda v: nearest(Fraction(v)),
    "_exact",
)
DATETIME = ValueCodec(
    (("", T.TimestampType()),),
    lambda v: (utc(v),),
    lambda cells: cells[0] if cells[0].tzinfo else cells[0].replace(tzinfo=UTC),
    utc,
)
SCALARS: dict[type, T.DataType] = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
}
_codecs: dict[type, ValueCodec] = {Fraction: FRACTION, datetime: DATETIME}


def register_value_codec(kind: type, codec: ValueCodec) -> None:
    """Store values of ``kind`` by ``codec``; a kind can be registered once."""
    if kind in _codecs or kind in SCALARS:
        raise ValueError(f"{kind.__name__} has a codec")
    _codecs[kind] = codec


def codec_of(kind: type) -> ValueCodec | None:
    return _codecs.get(kind)


def checked(kind: type, value: Any) -> Any:
    """A scalar of exactly the declared kind (bool is no int, int is a float)."""
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, bool) != (kind is bool) or not isinstance(value, kind):
        raise TypeError(f"expected {kind.__name__}, got {value!r}")
    if kind is int and not -(1 << 63) <= value < 1 << 63:
        raise OverflowError(f"{value} doesn't fit 64 bits")
    return value

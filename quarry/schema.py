"""Record schemas, resolved once from plain frozen dataclasses."""

from __future__ import annotations

import dataclasses
import functools
import types
import typing
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from quarry.functions.codecs import SCALARS, ValueCodec, codec_of


class SchemaError(TypeError):
    """A class that can't be stored."""


class Marker:
    pass


class Indexed(Marker):
    """Rows are clustered by this field when a table is compacted."""


class Unique(Marker):
    """Integrity checks report values of this field that repeat."""


class Skip(Marker):
    """Not stored; the field needs a default."""


class IdentitySkip(Marker):
    """Stored, but no part of a record's identity."""


@dataclass(frozen=True)
class Shape(Marker):
    """A tensor of rationals; 0 rows means any number."""

    rows: int
    columns: int


@dataclass(frozen=True)
class StorageInfo:
    """``name`` of the table and how equal records are found: content_id, by_value or none."""

    name: str | None = None
    dedup: str = "content_id"


@dataclass(frozen=True)
class FieldSpec:
    name: str
    role: str  # scalar, encoded, tensor, reference, child_scalar, child_encoded, child_reference
    kind: Any
    nullable: bool
    markers: tuple[Any, ...] = ()
    codec: ValueCodec | None = None
    as_tuple: bool = False

    def marked(self, marker: type) -> bool:
        return any(m is marker or isinstance(m, marker) for m in self.markers)

    @property
    def columns(self) -> list[T.StructField]:
        def column(suffix: str, kind: T.DataType) -> T.StructField:
            return T.StructField(self.name + suffix, kind, True)

        match self.role:
            case "scalar":
                return [column("", SCALARS[self.kind])]
            case "encoded":
                return [column(s, t) for s, t in self.codec.columns]
            case "tensor":
                rows = T.ArrayType(T.ArrayType(T.DoubleType()))
                return [column("", rows), column("_exact", T.ArrayType(T.ArrayType(T.StringType())))]
            case "reference":
                return [column("_sid", T.LongType())]
            case "child_scalar":
                return [column("", T.ArrayType(SCALARS[self.kind]))]
            case "child_encoded":
                return [column(s, T.ArrayType(t)) for s, t in self.codec.columns]
        return [column("_sids", T.ArrayType(T.LongType()))]

    @property
    def identity_cells(self) -> list[tuple[str, T.DataType]]:
        """Names and types of what an identity is made of: references count by their identities."""
        kinds = {"reference": T.StringType(), "child_reference": T.ArrayType(T.StringType())}
        return [(c.name, kinds.get(self.role, c.dataType)) for c in self.columns]


@dataclass(frozen=True)
class RecordSchema:
    cls: type
    name: str
    dedup: str
    fields: tuple[FieldSpec, ...]

    def field(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise AttributeError(f"{self.name} has no field {name}")

    @property
    def identity_fields(self) -> list[FieldSpec]:
        """Fields that make up an identity: under ``by_value`` all but collections, else all that aren't marked."""
        if self.dedup == "by_value":
            return [f for f in self.fields if not f.role.startswith("child")]
        return [f for f in self.fields if not f.marked(IdentitySkip)]

    @property
    def identity_head(self) -> str:
        return f"{self.name}:{self.dedup}"

    @property
    def references(self) -> list[type]:
        return [f.kind for f in self.fields if f.role in ("reference", "child_reference")]

    @property
    def struct(self) -> T.StructType:
        """Columns of the record's table; the store's own come first."""
        own = [
            T.StructField("sid", T.LongType(), False),
            T.StructField("role", T.IntegerType(), False),
            T.StructField("store_timestamp", T.LongType(), False),
            T.StructField("logical_id", T.LongType(), False),
            T.StructField("identity", T.StringType(), False),
        ]
        return T.StructType(own + [c for f in self.fields for c in f.columns])

    @property
    def fingerprint(self) -> list[str]:
        return [f"{c.name}:{c.dataType.simpleString()}" for c in self.struct]


RESERVED = frozenset({"sid", "role", "store_timestamp", "logical_id", "identity"})


_storage: dict[type, StorageInfo] = {}


def declare_storage(cls: type, info: StorageInfo) -> None:
    """Give a class that can't declare ``__storage__`` itself its storage; a class has one."""
    if _storage.get(cls, info) != info or hasattr(cls, "__storage__"):
        raise SchemaError(f"{cls.__name__} has its storage already")
    _storage[cls] = info
    resolve.cache_clear()


@functools.cache
def resolve(cls: type) -> RecordSchema:
    """The schema of a storable class."""
    if not dataclasses.is_dataclass(cls) or not cls.__dataclass_params__.frozen:
        raise SchemaError(f"{cls.__name__} isn't a frozen dataclass")
    info = _storage.get(cls) or getattr(cls, "__storage__", StorageInfo())
    if info.dedup not in ("content_id", "by_value", "none"):
        raise SchemaError(f"unknown dedup policy {info.dedup!r}")
    hints = typing.get_type_hints(cls, include_extras=True)
    fields = []
    for f in dataclasses.fields(cls):
        if f.name in RESERVED:
            raise SchemaError(f"{cls.__name__}.{f.name} is a reserved name")
        spec = resolve_field(cls, f.name, hints[f.name])
        if spec.marked(Skip):
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                raise SchemaError(f"{cls.__name__}.{f.name} is skipped and has no default")
            continue
        fields.append(spec)
    names = [c.name for f in fields for c in f.columns]
    if len(set(names)) < len(names):
        raise SchemaError(f"{cls.__name__} has fields whose columns clash")
    return RecordSchema(cls, info.name or cls.__name__.lower(), info.dedup, tuple(fields))


def resolve_field(cls: type, name: str, hint: Any) -> FieldSpec:
    markers: tuple[Any, ...] = ()
    nullable = False
    where = f"{cls.__name__}.{name}"
    while True:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if origin is typing.Annotated:
            hint, markers = args[0], markers + tuple(args[1:])
        elif origin in (typing.Union, types.UnionType):
            others = [a for a in args if a is not type(None)]
            if len(others) != 1 or len(others) == len(args):
                raise SchemaError(f"{where}: only unions with None are storable")
            hint, nullable = others[0], True
        else:
            break
    if any(isinstance(m, Shape) for m in markers):
        return FieldSpec(name, "tensor", hint, nullable, markers)
    if origin in (list, tuple):
        if origin is tuple and (len(args) != 2 or args[1] is not Ellipsis):
            raise SchemaError(f"{where}: tuples need the form tuple[T, ...]")
        kind, _ = args[0], None
        as_tuple = origin is tuple
        if kind in SCALARS:
            return FieldSpec(name, "child_scalar", kind, nullable, markers, None, as_tuple)
        if codec := codec_of(kind):
            return FieldSpec(name, "child_encoded", kind, nullable, markers, codec, as_tuple)
        if dataclasses.is_dataclass(kind):
            return FieldSpec(name, "child_reference", kind, nullable, markers, None, as_tuple)
        raise SchemaError(f"{where}: {kind!r} isn't storable in a collection")
    if hint in SCALARS:
        return FieldSpec(name, "scalar", hint, nullable, markers)
    if codec := codec_of(hint):
        return FieldSpec(name, "encoded", hint, nullable, markers, codec)
    if dataclasses.is_dataclass(hint):
        return FieldSpec(name, "reference", hint, nullable, markers)
    raise SchemaError(f"{where}: {hint!r} isn't storable")

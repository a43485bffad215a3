"""Object graphs to rows and back."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable
from fractions import Fraction
from typing import Any

from quarry.functions.codecs import FRACTION, checked
from quarry.schema import FieldSpec, IdentitySkip, RecordSchema, Shape, resolve
from quarry.sources.canonical import identity_text


def tensor_cells(spec: FieldSpec, value: Any) -> tuple[list, list]:
    shape = next(m for m in spec.markers if isinstance(m, Shape))
    rows = [[Fraction(x) for x in row] for row in value]
    if (shape.rows and len(rows) != shape.rows) or any(len(r) != shape.columns for r in rows):
        raise ValueError(f"{spec.name} isn't {shape.rows} x {shape.columns}")
    return [[float(x) for x in r] for r in rows], [[FRACTION.encode(x)[1] for x in r] for r in rows]


class Encoder:
    """Turns objects into rows by table, each object once; references become identities.

    A row's identity is the hash of the canonical texts of its identity cells, with
    references by their identities; records of policy ``none`` get a unique one.
    ``before`` has the number of rows by class that earlier encoders made; records of
    ``promote`` count as roots wherever they stand.
    """

    def __init__(self, before: dict[type, int] | None = None, promote: tuple[type, ...] = ()) -> None:
        self.rows: dict[type, dict[str, dict[str, Any]]] = {}
        self.before, self.promote = before or {}, promote
        self.conflicts: list[tuple[str, str]] = []
        self._seen: dict[int, tuple[str, Any]] = {}
        self._open: set[int] = set()

    def add(self, obj: Any, role: int = 1) -> str:
        if id(obj) in self._open:
            raise ValueError("a record can't contain itself")
        known = self._seen.get(id(obj))
        if known is not None:
            row = self.rows[type(obj)][known[0]]
            row["role"] = max(row["role"], role)
            return known[0]
        schema = resolve(type(obj))
        self._open.add(id(obj))
        try:
            row = {f.name: self._cells(f, getattr(obj, f.name)) for f in schema.fields}
        finally:
            self._open.discard(id(obj))
        identity = self._identity(schema, row)
        flat = {"identity": identity, "role": role, "ordinal": self.before.get(type(obj), 0) + len(self.rows.get(type(obj), ()))}
        for f in schema.fields:
            for column, cell in zip(f.columns, row[f.name], strict=True):
                flat[column.name] = cell
        table = self.rows.setdefault(type(obj), {})
        if identity in table:
            before = table[identity]
            skipped = [c.name for f in schema.fields if f.marked(IdentitySkip) for c in f.columns]
            if any(before[c] != flat[c] for c in skipped):
                self.conflicts.append((schema.name, identity))
            before["role"] = max(before["role"], role)
        else:
            table[identity] = flat
        self._seen[id(obj)] = (identity, obj)
        return identity

    def _identity(self, schema: RecordSchema, row: dict[str, list]) -> str:
        if schema.dedup == "none":
            return f"new-{uuid.uuid4().hex}"
        cells = [(*c, v) for f in schema.identity_fields for c, v in zip(f.identity_cells, row[f.name], strict=True)]
        return identity_text(schema.identity_head, [(name, value, kind) for name, kind, value in cells])

    def _cells(self, f: FieldSpec, value: Any) -> list:
        if value is None:
            if not f.nullable:
                raise ValueError(f"{f.name} can't be None")
            return [None] * len(f.columns)
        match f.role:
            case "scalar":
                return [checked(f.kind, value)]
            case "encoded":
                return list(f.codec.encode(value))
            case "tensor":
                return list(tensor_cells(f, value))
            case "reference":
                return [self._reference(f, value)]
            case "child_scalar":
                return [[checked(f.kind, v) for v in value]]
            case "child_encoded":
                cells = [f.codec.encode(v) for v in value]
                return [[c[i] for c in cells] for i in range(len(f.columns))]
        return [[self._reference(f, v) for v in value]]

    def _reference(self, f: FieldSpec, value: Any) -> str:
        if not isinstance(value, f.kind):
            raise TypeError(f"{f.name} expects {f.kind.__name__}")
        return self.add(value, 1 if isinstance(value, self.promote) else 0)


def decode(schema: RecordSchema, row: dict[str, Any], fetch: Callable[[type, int], Any]) -> Any:
    """The object of a row; ``fetch`` gives records that it refers to."""
    values = {}
    for f in schema.fields:
        cells = [row[c.name] for c in f.columns]
        if cells[0] is None:
            values[f.name] = None
            continue
        kind = tuple if f.as_tuple else list
        match f.role:
            case "scalar":
                values[f.name] = bytes(cells[0]) if f.kind is bytes else cells[0]
            case "encoded":
                values[f.name] = f.codec.decode(tuple(cells))
            case "tensor":
                values[f.name] = tuple(tuple(Fraction(x) for x in r) for r in cells[1])
            case "reference":
                values[f.name] = fetch(f.kind, cells[0])
            case "child_scalar":
                values[f.name] = kind(cells[0])
            case "child_encoded":
                values[f.name] = kind(f.codec.decode(c) for c in zip(*cells, strict=True))
            case _:
                values[f.name] = kind(fetch(f.kind, s) for s in cells[0])
    obj = schema.cls(**values)
    object.__setattr__(obj, "_quarry_sid", row["sid"])
    return obj


def same_record(a: Any, b: Any) -> bool:
    return dataclasses.asdict(a) == dataclasses.asdict(b)

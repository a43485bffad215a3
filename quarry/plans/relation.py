"""What a search ranges over: tables with keys, references and collections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Child:
    """A collection field of a relation.

    ``inline`` collections are an array column of the relation itself, so their
    quantifiers run inside the scan.  Others are a table with a parent key; its
    ``fields`` are element columns, ``value`` the one that quantifiers test.
    ``target`` names the relation that elements refer to by key, if they do.
    """

    name: str
    inline: str | None = None
    frame: Callable[[], DataFrame] | None = None
    parent_key: str = ""
    order: str | None = None
    value: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    target: Callable[[], Relation] | None = None
    exact: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Relation:
    """A record table: ``frame()`` with a unique ``key`` column.

    ``fields`` maps names to columns, ``references`` names to (foreign key column,
    relation), ``exact`` names to the column of the exact text of a rational.
    """

    name: str
    frame: Callable[[], DataFrame]
    key: str
    fields: dict[str, str]
    references: dict[str, tuple[str, Callable[[], Relation]]] = field(default_factory=dict)
    children: dict[str, Child] = field(default_factory=dict)
    exact: dict[str, str] = field(default_factory=dict)
    timestamp: str | None = None
    logical: str | None = None
    encode: Callable[[str, object], object] | None = None
    hydrate: Callable[[int], object] | None = None
    opaque: frozenset[str] = frozenset()
    presence: dict[str, str] = field(default_factory=dict)
    identity: str | None = None
    resolution: int | None = None  # nanoseconds of a timestamp unit; results show nanoseconds
    hydrate_many: Callable[[Sequence[int]], list[object]] | None = None


def relation_of_frame(
    name: str,
    frame: Callable[[], DataFrame],
    key: str,
    fields: dict[str, str] | None = None,
    **parts,
) -> Relation:
    """A relation over any DataFrame; without ``fields`` every column is a field."""
    names = fields if fields is not None else {c: c for c in frame().columns}
    return Relation(name, frame, key, names, **parts)

"""Predicates, fields and scopes of a search, and how they become columns.

Every row source (variable, reference path, scope) has a tag, and its columns
are named with it, so expressions are columns by name from the start.  A test of
a collection that isn't inline is an atom: a grouped aggregate of the child
table, joined to its owner by key.  All atoms on one child table share one
aggregation and so one shuffle.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.rationals import scaled_equal
from quarry.plans.relation import Child, Relation

_tags = itertools.count()


class Source:
    """One occurrence of a relation or of a child table in a search."""

    def __init__(self, relation: Relation | None, label: str, child: Child | None = None, parent: Source | None = None):
        self.relation, self.child, self.parent, self.label = relation, child, parent, label
        self.tag = f"q{next(_tags)}_"
        self.references: dict[str, Source] = {}

    def column(self, name: str) -> Column:
        return F.col(f"{self.tag}{name}")

    @property
    def key(self) -> Column:
        return self.column(self.relation.key)

    def renamed(self, frame: DataFrame) -> DataFrame:
        return frame.select(*[F.col(f"`{c}`").alias(f"{self.tag}{c}") for c in frame.columns])

    def reference(self, name: str) -> Source:
        """The source behind a reference; one for each path."""
        if name not in self.references:
            target = self.relation.references[name][1]()
            self.references[name] = Source(target, f"{self.label}.{name}", parent=self)
        return self.references[name]

    def walk(self) -> Iterator[Source]:
        yield self
        for s in self.references.values():
            yield from s.walk()


@dataclass(eq=False)
class Atom:
    """A value per row of ``owner``, aggregated over its rows in ``scope``."""

    owner: Source
    scope: Source
    aggregate: Callable[[Column], Column]
    condition: Predicate
    empty: Any
    name: str = field(default_factory=lambda: f"atom{next(_tags)}")


@dataclass(frozen=True, eq=False)
class Predicate:
    """A boolean column with the sources and atoms that it needs.

    ``test`` is set where the predicate is nothing but whether an atom's scope has a
    row that satisfies its condition (true), or has none (false): as a conjunct
    that needs a semi-join and no aggregate.  ``by_python`` predicates can't be join conditions.
    ``equal`` is set where it is nothing but an equality of two columns, each with its sources.
    """

    column: Column
    sources: frozenset[Source] = frozenset()
    atoms: tuple[Atom, ...] = ()
    text: str = ""
    parts: tuple[Predicate, ...] = ()
    test: tuple[Atom, bool] | None = None
    by_python: bool = False
    equal: tuple[tuple[Column, frozenset[Source]], tuple[Column, frozenset[Source]]] | None = None

    def _with(self, other: Predicate, column: Column, sign: str, parts: tuple[Predicate, ...] = ()) -> Predicate:
        if not isinstance(other, Predicate):
            raise TypeError(f"not a predicate: {other!r}")
        text = f"({self.text} {sign} {other.text})"
        python = self.by_python or other.by_python
        return Predicate(column, self.sources | other.sources, self.atoms + other.atoms, text, parts, by_python=python)

    def __and__(self, other: Predicate) -> Predicate:
        return self._with(other, self.column & other.column, "AND", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return self._with(other, self.column | other.column, "OR")

    def __invert__(self) -> Predicate:
        test = (self.test[0], not self.test[1]) if self.test else None
        return Predicate(~self.column, self.sources, self.atoms, f"NOT {self.text}", test=test, by_python=self.by_python)

    def __bool__(self) -> bool:
        raise TypeError("a predicate has no truth value; combine predicates with &, | and ~")

    def conjuncts(self) -> Iterator[Predicate]:
        if self.parts:
            for p in self.parts:
                yield from p.conjuncts()
        else:
            yield self



def constant(value: bool | None) -> Predicate:
    return Predicate(F.lit(value).cast("boolean"), text=str(value).upper())


class Value:
    """A scalar that can be compared: a field, a constant or an aggregate of a scope."""

    def __init__(self, column: Column, text: str, sources=frozenset(), atoms=(), encode=None, exact: Column | None = None, shown: Column | None = None):
        self._column, self._text, self._sources, self._atoms = column, text, frozenset(sources), tuple(atoms)
        self._encode, self._exact = encode or (lambda v: v), exact
        self._shown = column if shown is None else shown  # as an output

    def _compare(self, other: Any, op: Callable, sign: str) -> Predicate:
        if other is None:
            if sign not in ("=", "!="):
                raise ValueError("None can only be compared for equality")
            null = self._column.isNull()
            column = null if sign == "=" else ~null
            return Predicate(column, self._sources, self._atoms, f"{self._text} {sign} NULL")
        if isinstance(other, Value):
            column = op(self._column, other._column)
            equal = ((self._column, self._sources), (other._column, other._sources)) if sign == "=" else None
            return Predicate(column, self._sources | other._sources, self._atoms + other._atoms, f"{self._text} {sign} {other._text}", equal=equal)
        column = op(self._column, F.lit(self._encode(other)))
        return Predicate(column, self._sources, self._atoms, f"{self._text} {sign} {other!r}")

    def __eq__(self, other: Any) -> Predicate:  # type: ignore[override]
        return self._compare(other, operator.eq, "=")

    def __ne__(self, other: Any) -> Predicate:  # type: ignore[override]
        return self._compare(other, operator.ne, "!=")

    def __lt__(self, other: Any) -> Predicate:
        return self._compare(other, operator.lt, "<")

    def __le__(self, other: Any) -> Predicate:
        return self._compare(other, operator.le, "<=")

    def __gt__(self, other: Any) -> Predicate:
        return self._compare(other, operator.gt, ">")

    def __ge__(self, other: Any) -> Predicate:
        return self._compare(other, operator.ge, ">=")

    __hash__ = object.__hash__

    def _literal(self, text: Any, method: str) -> Predicate:
        if isinstance(text, Value):
            column, sources, atoms = text._column, text._sources, text._atoms
        else:
            column, sources, atoms = F.lit(text), frozenset(), ()
        test = getattr(self._column, method)(column)
        return Predicate(test, self._sources | sources, self._atoms + atoms, f"{self._text} {method} {text!r}")

    def contains(self, text: Any) -> Predicate:
        return self._literal(text, "contains")

    def startswith(self, text: Any) -> Predicate:
        return self._literal(text, "startswith")

    def endswith(self, text: Any) -> Predicate:
        return self._literal(text, "endswith")

    def is_in(self, *values: Any) -> Predicate:
        """Two-valued membership; None is a member that null matches."""
        known = [self._encode(v) for v in values if v is not None]
        column = self._column.isNotNull() & self._column.isin(known) if known else F.lit(False)
        if len(known) < len(values):
            column = column | self._column.isNull()
        return Predicate(column, self._sources, self._atoms, f"{self._text} IN {values!r}")

    def exactly(self, other: Any) -> Predicate:
        """Equality of exact values, by the exact text where the field has one."""
        if isinstance(other, Value):
            if self._exact is None or other._exact is None:
                return self == other
            column = self._exact == other._exact
            equal = (self._exact, self._sources), (other._exact, other._sources)
            return Predicate(column, self._sources | other._sources, self._atoms + other._atoms, f"{self._text} == {other._text}", equal=equal)
        if self._exact is None:
            return self == other
        from quarry.functions.codecs import exact_text

        return Predicate(self._exact == F.lit(exact_text(other)), self._sources, self._atoms, f"{self._text} == {other!r}")


def scaled_exactly_equal(left: Value, left_factor: int, right: Value, right_factor: int) -> Predicate:
    """left * left_factor = right * right_factor over rationals; null if either is."""
    if left._exact is None or right._exact is None:
        raise TypeError("exact scaling needs rational fields")
    near = F.abs(left._column * left_factor - right._column * right_factor) <= F.lit(1e-9) * (
        F.abs(left._column * left_factor) + F.abs(right._column * right_factor)
    ) + F.lit(1e-300)
    # The float companions decide all but near misses, so few rows reach Python.
    exact = scaled_equal(left._exact, F.lit(str(left_factor)), right._exact, F.lit(str(right_factor)))
    column = F.when(~near, F.lit(False)).otherwise(exact)
    text = f"{left._text} * {left_factor} == {right._text} * {right_factor}"
    return Predicate(column, left._sources | right._sources, left._atoms + right._atoms, text, by_python=True)


def when_known(known: Predicate, predicate: Predicate) -> Predicate:
    """``predicate`` where ``known`` holds, unknown elsewhere, also under negation."""
    both = known & predicate
    return Predicate(F.when(known.column, predicate.column), both.sources, both.atoms, f"WHEN {known.text} THEN {predicate.text}", by_python=both.by_python)


class Scope:
    """Rows that belong to one row of ``owner``: a child collection or records that refer to it."""

    def __init__(self, owner: Source, source: Source, filters: tuple[Predicate, ...] = ()):
        self._owner, self._source, self._filters = owner, source, filters

    def where(self, predicate: Predicate) -> Scope:
        return Scope(self._owner, self._source, (*self._filters, predicate))

    def _condition(self, predicate: Predicate | None) -> Predicate:
        out = constant(True)
        for p in (*self._filters, *([predicate] if predicate is not None else [])):
            out = out & p
        return out

    def _atom(self, aggregate, predicate: Predicate | None, empty: Any) -> Atom:
        return Atom(self._owner, self._source, aggregate, self._condition(predicate), empty)

    def exists(self, predicate: Predicate | None = None) -> Predicate:
        atom = self._atom(lambda c: F.max(F.coalesce(c, F.lit(False))), predicate, False)
        text = f"EXISTS {self._source.label}({atom.condition.text})"
        return Predicate(F.col(atom.name), frozenset({self._owner}), (atom,), text, test=(atom, True))

    def count(self, predicate: Predicate | None = None) -> Value:
        atom = self._atom(lambda c: F.count_if(F.coalesce(c, F.lit(False))), predicate, 0)
        return Value(F.col(atom.name), f"COUNT {self._source.label}({atom.condition.text})", {self._owner}, (atom,))

    def distinct_count(self, value: Value, predicate: Predicate | None = None) -> Value:
        column = value._exact if value._exact is not None else value._column
        atom = self._atom(lambda c: F.count_distinct(F.when(c, column)), predicate, 0)
        return Value(F.col(atom.name), f"DISTINCT {value._text}({atom.condition.text})", {self._owner}, (atom,))

    def scope(self, name: str) -> Scope:
        return child_scope(self._source, name)

    def referring(self, relation: Relation, field_name: str) -> Scope:
        return referring_scope(self._source, relation, field_name)

    def field(self, name: str) -> Value:
        return getattr(self, name)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        source = self._source
        if source.child is None:
            return Variable(source).__getattr__(name)
        child = source.child
        if name in child.fields or name == "value":
            column = child.fields.get(name, child.value)
            exact = source.column(child.exact[name]) if name in child.exact else None
            return Value(source.column(column), f"{source.label}.{name}", {source}, (), exact=exact)
        if child.target is not None:
            return getattr(Variable(source.references["*"]), name)
        raise AttributeError(f"{source.label} has no field {name}")


def child_scope(owner: Source, name: str) -> Scope:
    child = owner.relation.children[name]
    source = Source(None, f"{owner.label}.{name}", child=child, parent=owner)
    if child.target is not None:
        source.references["*"] = Source(child.target(), f"{source.label}.*", parent=source)
    return Scope(owner, source)


def referring_scope(owner: Source, relation: Relation, field_name: str) -> Scope:
    source = Source(relation, f"{relation.name}.{field_name}->{owner.label}", parent=owner)
    source.link = relation.references[field_name][0]
    return Scope(owner, source)


class Collection:
    """A collection field: every test is over its elements and true or false, never unknown."""

    def __init__(self, owner: Source, child: Child, encode: Callable[[Any], Any] | None = None):
        self._owner, self._child = owner, child
        self._encode = encode or (lambda v: v)
        self._text = f"{owner.label}.{child.name}"

    def _some(self, test: Callable[[Column], Column], text: str) -> Predicate:
        if self._child.inline is not None:
            values = self._owner.column(self._child.inline)
            found = F.coalesce(F.exists(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))
            return Predicate(found, frozenset({self._owner}), (), text)
        scope = child_scope(self._owner, self._child.name)
        out = scope.exists(Predicate(test(scope.value._column), frozenset({scope._source}), text=text))
        return Predicate(out.column, out.sources, out.atoms, text, test=out.test)

    def _members(self, values: Iterable[Any]) -> list[Any]:
        if any(v is None for v in values):
            raise ValueError("None can't be a member of a collection test")
        return [self._encode(v) for v in values]

    def _compare(self, other: Any, op: Callable, sign: str) -> Predicate:
        if other is None:
            raise ValueError("a collection can't be compared with None")
        value = F.lit(self._encode(other))
        return self._some(lambda v: op(v, value), f"{self._text} {sign} {other!r}")

    __eq__ = lambda self, o: self._compare(o, operator.eq, "=")
    __ne__ = lambda self, o: self._compare(o, operator.ne, "!=")
    __lt__ = lambda self, o: self._compare(o, operator.lt, "<")
    __le__ = lambda self, o: self._compare(o, operator.le, "<=")
    __gt__ = lambda self, o: self._compare(o, operator.gt, ">")
    __ge__ = lambda self, o: self._compare(o, operator.ge, ">=")
    __hash__ = object.__hash__

    def contains(self, text: str) -> Predicate:
        return self._some(lambda v: v.contains(text), f"{self._text} contains {text!r}")

    def startswith(self, text: str) -> Predicate:
        return self._some(lambda v: v.startswith(text), f"{self._text} startswith {text!r}")

    def endswith(self, text: str) -> Predicate:
        return self._some(lambda v: v.endswith(text), f"{self._text} endswith {text!r}")

    def has_any(self, *values: Any) -> Predicate:
        members = self._members(values)
        if not members:
            return constant(False)
        return self._some(lambda v: v.isin(members), f"{self._text} HAS ANY {values!r}")

    def has(self, value: Any) -> Predicate:
        return self.has_any(value)

    def has_only(self, *values: Any) -> Predicate:
        """No element outside ``values``; true for an empty and for a null collection."""
        members = self._members(values)
        outside = self._some(lambda v: v.isNotNull() & ~v.isin(members) if members else v.isNotNull(), "outside")
        none = ~outside
        return Predicate(none.column, none.sources, none.atoms, f"{self._text} HAS ONLY {values!r}", test=none.test)

    def is_in(self, *values: Any) -> Predicate:
        return self.has_only(*values)

    def length(self) -> Value:
        if self._child.inline is not None:
            size = F.coalesce(F.size(self._owner.column(self._child.inline)), F.lit(0))
            return Value(F.greatest(size, F.lit(0)), f"LENGTH {self._text}", {self._owner})
        return child_scope(self._owner, self._child.name).count()

    def __getattr__(self, name: str) -> Any:
        """A field of the records in the collection: tests are existential."""
        if name.startswith("_") or (self._child.target is None and name not in self._child.fields):
            raise AttributeError(f"{self._text} has no field {name}")
        return ElementField(self._owner, self._child.name, name)


class ElementField:
    """A field of a collection's elements; every test holds if some element passes it."""

    def __init__(self, owner: Source, child: str, name: str):
        self._owner, self._child, self._name = owner, child, name

    def _some(self, test: Callable[[Value], Predicate]) -> Predicate:
        scope = child_scope(self._owner, self._child)
        return scope.exists(test(getattr(scope, self._name)))

    __eq__ = lambda self, o: self._some(lambda v: v == o)
    __ne__ = lambda self, o: self._some(lambda v: v != o)
    __lt__ = lambda self, o: self._some(lambda v: v < o)
    __le__ = lambda self, o: self._some(lambda v: v <= o)
    __gt__ = lambda self, o: self._some(lambda v: v > o)
    __ge__ = lambda self, o: self._some(lambda v: v >= o)
    __hash__ = object.__hash__

    def contains(self, text: str) -> Predicate:
        return self._some(lambda v: v.contains(text))

    def startswith(self, text: str) -> Predicate:
        return self._some(lambda v: v.startswith(text))

    def endswith(self, text: str) -> Predicate:
        return self._some(lambda v: v.endswith(text))

    def has_any(self, *values: Any) -> Predicate:
        return self._some(lambda v: v.is_in(*values))

    has = is_in = has_any


class Reference:
    """A reference field: comparable with variables, stored keys and None; its attributes are the target's."""

    def __init__(self, owner: Source, name: str):
        self._owner, self._name = owner, name
        self._key = owner.column(owner.relation.references[name][0])
        self._text = f"{owner.label}.{name}"

    def _compare(self, other: Any) -> Predicate:
        if other is None:
            return Predicate(self._key.isNull(), frozenset({self._owner}), (), f"{self._text} = NULL")
        if isinstance(other, Variable):
            both = frozenset({self._owner, other._source})
            equal = (self._key, frozenset({self._owner})), (other._source.key, frozenset({other._source}))
            return Predicate(self._key == other._source.key, both, (), f"{self._text} = {other._source.label}", equal=equal)
        return Predicate(self._key == F.lit(_sid(other)), frozenset({self._owner}), (), f"{self._text} = {_sid(other)}")

    __eq__ = lambda self, o: self._compare(o)
    __ne__ = lambda self, o: ~self._compare(o)
    __hash__ = object.__hash__

    def has_any(self, *values: Any) -> Predicate:
        keys = [_sid(v) for v in values]
        column = F.coalesce(self._key.isin(keys), F.lit(False)) if keys else F.lit(False)
        return Predicate(column, frozenset({self._owner}), (), f"{self._text} HAS ANY {keys}")

    has = has_any

    def has_only(self, *values: Any) -> Predicate:
        inside = self.has_any(*values)
        return Predicate(self._key.isNull() | inside.column, inside.sources, (), f"{self._text} HAS ONLY {values!r}")

    is_in = has_any

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(Variable(self._owner.reference(self._name)), name)


def _sid(value: Any) -> int:
    sid = value if isinstance(value, int) else getattr(value, "sid", None) or getattr(value, "_quarry_sid", None)
    if sid is None:
        raise ValueError("a reference compares with variables, stored records and keys")
    return sid


class Variable:
    """A record variable: attributes are its fields, references and collections."""

    def __init__(self, source: Source):
        self._source = source

    def always_true(self) -> Predicate:
        return constant(True)

    def always_false(self) -> Predicate:
        return constant(False)

    def scope(self, name: str) -> Scope:
        return child_scope(self._source, name)

    def referring(self, relation: Relation, field_name: str) -> Scope:
        return referring_scope(self._source, relation, field_name)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        source, relation = self._source, self._source.relation
        label = f"{source.label}.{name}"
        if name in relation.opaque:
            raise TypeError(f"{label} can't be queried as a whole")
        if name in relation.fields:
            exact = source.column(relation.exact[name]) if name in relation.exact else None
            encode = (lambda v: relation.encode(name, v)) if relation.encode else None
            return Value(source.column(relation.fields[name]), label, {source}, (), encode, exact)
        if name in relation.references:
            return Reference(source, name)
        if name in relation.children:
            encode = (lambda v: relation.encode(name, v)) if relation.encode else None
            return Collection(source, relation.children[name], encode)
        if name in relation.presence:
            return Value(source.column(relation.presence[name]).isNotNull(), label, {source})
        special = {"sid": relation.key, "logical_id": relation.logical, "store_timestamp": relation.timestamp, "content_id": relation.identity}.get(name)
        if special is None:
            raise AttributeError(f"{relation.name} has no field {name}")
        column = source.column(special)
        if name == "store_timestamp" and relation.resolution is not None:
            unit = relation.resolution
            return Value(column, label, {source}, (), lambda v: instant(v, unit), shown=column * F.lit(unit))
        return Value(column, label, {source})


def instant(value: Any, resolution: int = 1000) -> int:
    """A point in time in units of ``resolution`` ns: from ns, an aware datetime or RFC 3339 text."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00").replace("z", "+00:00"))
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError("a point in time needs its offset from UTC")
        since = value.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
        value = ((since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds) * 1000
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError("a point in time is nanoseconds, a datetime or RFC 3339 text")
    return value // resolution

"""Entries of one type served from several stores and record classes as one.

Each backing (a record class of a store) gives a stream of candidates: public id,
sort keys and the rendered properties.  Streams are united, counted, sorted and cut
by Spark; only the rows of a page reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.federation import SourceError
from quarry.operators.filters import INVERTED, FilterError, Translator, converted, parse
from quarry.plans.expr import Predicate, Value, Variable


class DuplicateEntryId(RuntimeError):
    """A public id that several records claim."""

    def __init__(self, public_id: str, origins: Sequence[tuple[str, str]]):
        super().__init__(f"{public_id} is claimed by {list(origins)}")
        self.public_id, self.origins = public_id, tuple(origins)


@dataclass(frozen=True)
class StoredProperty:
    """How one property of an entry follows from a record.

    ``response`` gives the value that is rendered, from a variable of the backing;
    ``query`` turns an operator and a converted constant into a predicate, by default
    a comparison of the response; ``sort`` gives the sort key, by default the response.
    """

    kind: str
    response: Callable[[Variable], Value]
    query: Callable[[Variable, str, Any], Predicate] | None = None
    sort: Callable[[Variable], Value] | None = None


@dataclass(frozen=True)
class EntrySource:
    """A store's record classes that back the entries, with the prefix of their public ids.

    A public id is the prefix and the record's content id.  ``properties`` has the
    property definitions by class.
    """

    name: str
    store: Any
    properties: Mapping[type, Mapping[str, StoredProperty]]
    prefix: str = ""
    only_latest: bool = False


@dataclass(frozen=True)
class EntryPage:
    rows: list[dict[str, Any]]
    total: int
    more: bool


@dataclass(frozen=True)
class EntryFederation:
    """Entries of ``entry_type`` from ``sources``, in the order in which these are given."""

    sources: Sequence[EntrySource]
    entry_type: str

    def query(
        self,
        text: str | None = None,
        *,
        sort: Sequence[tuple[str, bool]] = (),
        offset: int = 0,
        limit: int | None = None,
        as_of: Any = None,
        fields: Sequence[str] | None = None,
    ) -> EntryPage:
        """A page of the entries that a filter selects, their number, and whether more follow.

        ``sort`` has (property, descending) keys, nulls last, ended by the public id;
        without it rows come by source, class and key.  With ``limit`` 0 there are only the
        counts.  A public id of the page that several records claim is an error.
        """
        if offset < 0 or (limit is not None and limit < 0):
            raise ValueError("offset and limit aren't negative")
        found = self.frame(text, sort=sort, as_of=as_of, fields=fields)
        total = found.count()
        size = None if limit is None else limit + 1
        rows = self.ordered(found, sort).offset(offset)
        got = (rows if size is None else rows.limit(size)).collect()
        more, got = (False, got) if limit is None else (len(got) > limit, got[:limit])
        self._check([r.id for r in got], as_of)
        return EntryPage([{"id": r.id, "type": self.entry_type, **json.loads(r.properties)} for r in got], total, more)

    def fetch(self, public_id: str, *, as_of: Any = None, fields: Sequence[str] | None = None) -> dict[str, Any] | None:
        """The entry of a public id, or None."""
        if not isinstance(public_id, str):
            raise TypeError("a public id is a string")
        got = self.frame(None, as_of=as_of, fields=fields).filter(F.col("id") == public_id).take(2)
        if len(got) > 1:
            self._check([public_id], as_of)
        return {"id": public_id, "type": self.entry_type, **json.loads(got[0].properties)} if got else None

    def duplicate_ids(self) -> DataFrame:
        """(id, origins): public ids that several records claim, within one source or among them."""
        ids = self.frame(None, fields=())
        origins = F.sort_array(F.collect_list(F.struct("origin", "backing")))
        return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"), origins.alias("origins")).filter("n > 1").drop("n")

    def frame(
        self, text: str | None, *, sort: Sequence[tuple[str, bool]] = (), as_of: Any = None, fields: Sequence[str] | None = None
    ) -> DataFrame:
        """Candidates (source, backing number, sid, id, origin, backing, k0..., properties as JSON), unordered."""
        frames = []
        tree = None if text is None else parse(text)
        for s, source in enumerate(self.sources):
            for b, (cls, properties) in enumerate(source.properties.items()):
                try:
                    frames.append(self._candidates(s, source, b, cls, properties, tree, [k for k, _ in sort], as_of, fields))
                except FilterError:
                    raise
                except Exception as wrong:
                    raise SourceError(source.name, wrong) from wrong
        if not frames:
            raise ValueError("a federation needs a source")
        return reduce(DataFrame.unionByName, frames)

    def _candidates(
        self,
        s: int,
        source: EntrySource,
        b: int,
        cls: type,
        properties: Mapping[str, StoredProperty],
        tree: tuple | None,
        sort: Sequence[str],
        as_of: Any,
        fields: Sequence[str] | None,
    ) -> DataFrame:
        search = source.store.searcher(as_of=as_of, only_latest=source.only_latest)
        v = search.variable(cls)
        if tree is not None:
            search.add(PropertyTranslator(v, properties, source.prefix, self.entry_type)(tree))
        for name in sort:
            if name != "id" and name not in properties:
                raise ValueError(f"{cls.__name__} has no property {name} to sort by")
        keys = [v.content_id if k == "id" else (properties[k].sort or properties[k].response)(v) for k in sort]
        wanted = [n for n in properties if fields is None or n in fields]
        outputs = {f"k{i}": k for i, k in enumerate(keys)} | {f"p{i}": properties[n].response(v) for i, n in enumerate(wanted)}
        rows = search.results(sid=v.sid, content_id=v.content_id, **outputs).to_frame()
        body = F.to_json(F.struct(*[F.col(f"p{i}").alias(n) for i, n in enumerate(wanted)]), {"ignoreNullFields": "false"}) if wanted else F.lit("{}")
        return rows.select(
            F.lit(s).alias("source"),
            F.lit(b).alias("number"),
            "sid",
            F.concat(F.lit(source.prefix), F.col("content_id")).alias("id"),
            F.lit(source.name).alias("origin"),
            F.lit(cls.__name__).alias("backing"),
            *[f"k{i}" for i in range(len(keys))],
            body.alias("properties"),
        )

    @staticmethod
    def ordered(found: DataFrame, sort: Sequence[tuple[str, bool]]) -> DataFrame:
        if not sort:
            return found.orderBy("source", "number", "sid")
        keys = [F.col(f"k{i}").desc_nulls_last() if down else F.col(f"k{i}").asc_nulls_last() for i, (_, down) in enumerate(sort)]
        return found.orderBy(*keys, "id", "source", "number")

    def _check(self, ids: Sequence[str], as_of: Any) -> None:
        """Raise on an id of a page (10,000 at most at once) that several records claim."""
        for start in range(0, len(ids), 10_000):
            part = list(ids[start : start + 10_000])
            claims = self.frame(None, as_of=as_of, fields=()).filter(F.col("id").isin(part))
            for r in claims.groupBy("id").agg(F.collect_list(F.struct("origin", "backing")).alias("by")).filter("size(by) > 1").take(1):
                raise DuplicateEntryId(r.id, [tuple(x) for x in r.by])


class PropertyTranslator(Translator):
    """Filters on properties of entries, by their query callbacks."""

    def __init__(self, variable: Variable, properties: Mapping[str, StoredProperty], prefix: str, entry_type: str):
        handlers = {n: self._handler(p) for n, p in properties.items() if p.query is not None}
        super().__init__(variable, {n: p.kind for n, p in properties.items()}, entry_type=entry_type, handlers=handlers | {"id": self._id(prefix)})
        self.responses = {n: p.response for n, p in properties.items()}

    def resolve(self, path: tuple[str, ...]) -> Any:
        if len(path) == 1 and path[0] in self.responses:
            return self.responses[path[0]](self.variable)
        if len(path) == 1 and path[0].startswith("_"):
            return None
        raise FilterError("unrecognized-property", f"unknown property {'.'.join(path)}")

    def _handler(self, of: StoredProperty) -> Callable[[Variable, tuple], Predicate]:
        def handle(variable: Variable, node: tuple) -> Predicate:
            match node:
                case (("IS_KNOWN" | "IS_UNKNOWN") as how, _):
                    return self.known(of.response(variable), how == "IS_KNOWN")
                case (("HAS_ALL" | "HAS_ANY" | "HAS_ONLY" | "LENGTH"), *_):
                    raise FilterError("not-implemented", "this property compares with one value")
                case (op, left, right):
                    op, right = inverted(op, left, right)
                    return of.query(variable, op, converted(right, of.kind))
            raise FilterError("internal", f"unknown node {node[0]!r}")

        return handle

    @staticmethod
    def _id(prefix: str) -> Callable[[Variable, tuple], Predicate]:
        def handle(variable: Variable, node: tuple) -> Predicate:
            match node:
                case ("IS_KNOWN", _):
                    return variable.always_true()
                case ("IS_UNKNOWN", _):
                    return variable.always_false()
                case (("=" | "!=") as op, left, right):
                    text = right if left[0] == "Identifier" else left
                    if text[0] != "String":
                        raise FilterError("type-mismatch", "an id is a string")
                    mine = text[1].startswith(prefix)
                    same = variable.content_id == text[1][len(prefix) :] if mine else variable.always_false()
                    return same if op == "=" else ~same
            raise FilterError("not-implemented", "ids compare by = and != only")

        return handle


def inverted(op: str, left: tuple, right: tuple) -> tuple[str, tuple]:
    """The operator and constant of a comparison whose property stands on the left."""
    return (op, right) if left[0] == "Identifier" else (INVERTED[op], left)

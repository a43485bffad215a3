"""Reading several sources as one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.results import Output, ResultSet
from quarry.plans.expr import Predicate, Variable


class SourceError(RuntimeError):
    """A failure of one source; there are no partial results."""

    def __init__(self, source: str, cause: Exception):
        super().__init__(f"source {source!r}: {cause}")
        self.source = source


def united(sources: Mapping[str, DataFrame]) -> DataFrame:
    if not sources:
        raise ValueError("a federation needs a source")
    names = next(iter(sources.values())).columns
    tagged = []
    for i, (name, frame) in enumerate(sources.items()):
        if sorted(frame.columns) != sorted(names):
            raise SourceError(name, ValueError(f"columns {frame.columns} instead of {names}"))
        tagged.append(frame.select(F.lit(i).alias("_source"), F.lit(name).alias("origin"), *names))
    return reduce(DataFrame.unionByName, tagged)


def source_major(sources: Mapping[str, DataFrame], key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """All sources' rows, the first source's first; no row is dropped as a duplicate."""
    if limit is not None:  # no source gives more than the slice can reach
        sources = {n: f.orderBy(key).limit(limit + offset) for n, f in sources.items()}
    out = united(sources)
    if limit is None and not offset:
        return out
    out = out.orderBy("_source", key).offset(offset)
    return out if limit is None else out.limit(limit)


def sorted_merge(
    sources: Mapping[str, DataFrame], order: Sequence[tuple[str, bool]], public_id: str, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Rows of all sources in one order: (column, descending) keys with nulls last, then public id, then source."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order] + [F.col(public_id)]
    if limit is not None:
        sources = {n: f.orderBy(*keys).limit(limit + offset) for n, f in sources.items()}
    out = united(sources).orderBy(*keys, "_source")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def duplicate_ids(sources: Mapping[str, DataFrame], public_id: str) -> DataFrame:
    """Public ids that more than one row claims."""
    ids = united({n: f.select(public_id) for n, f in sources.items()})
    return ids.groupBy(public_id).agg(F.count(F.lit(1)).alias("claims")).filter("claims > 1")


class FederatedSearch:
    """One search replayed over several stores; results are source-major.

    ``condition`` takes a variable and gives a predicate; ``outputs`` takes one
    and gives named fields.  Sorting is by source and key only.
    """

    def __init__(self, stores: Mapping[str, Any], kind: type | Mapping[str, type], *, as_of: Any = None, only_latest: bool = False):
        self.stores, self.kind = stores, kind
        self.as_of, self.only_latest = as_of, only_latest
        self._count: int | None = None
        self.conditions: list[Callable[[Variable], Predicate]] = []

    def add(self, condition: Callable[[Variable], Predicate]) -> FederatedSearch:
        self.conditions.append(condition)
        return self

    def _searches(self) -> dict[str, tuple[Any, Variable]]:
        out = {}
        for name, store in self.stores.items():
            kind = self.kind[name] if isinstance(self.kind, Mapping) else self.kind
            try:
                s = store.searcher(as_of=self.as_of, only_latest=self.only_latest)
                v = s.variable(kind)
                for c in self.conditions:
                    s.add(c(v))
            except Exception as wrong:
                raise SourceError(name, wrong) from wrong
            out[name] = (s, v)
        return out

    def frame(self, limit: int | None = None, offset: int = 0, **outputs: Callable[[Variable], Any]) -> DataFrame:
        frames = {}
        for name, (s, v) in self._searches().items():
            frames[name] = s.results(sid=v.sid, **{k: f(v) for k, f in outputs.items()}).to_frame()
        return source_major(frames, "sid", limit, offset)

    def results(self, **outputs: Callable[[Variable], Any]) -> ResultSet:
        """The sources' rows as one result set, source-major: iterable, sliceable, with first(), one() and scalars()."""
        frame = self.frame(**outputs)
        return ResultSet(frame, [Output(k, F.col(k)) for k in ("origin", *outputs)], [], [F.col("_source"), F.col("sid")])

    def count(self) -> int:
        """Sum of the sources' counts; taken once."""
        if self._count is None:
            total = 0
            for name, (s, _) in self._searches().items():
                try:
                    total += s.count()
                except Exception as wrong:
                    raise SourceError(name, wrong) from wrong
            self._count = total
        return self._count

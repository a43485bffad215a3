"""Frozen results of a search: rows, slices, columns and keyset pages."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import paging
from quarry.operators.paging import PageOrder

MOST_KEYS, MOST_ROWS = 32, 10_000
#: Rows whose records are read together.
HYDRATED_ROWS = 500


class ResultRow(tuple):
    """A row that can be read by position, name and attribute."""

    _names: tuple[str, ...]

    def __new__(cls, values: Sequence[Any], names: Sequence[str]) -> ResultRow:
        row = super().__new__(cls, values)
        row._names = tuple(names)
        return row

    def __getitem__(self, at: Any) -> Any:
        if isinstance(at, str):
            if at not in self._names:
                raise KeyError(at)
            at = self._names.index(at)
        return super().__getitem__(at)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return self[name]

    def as_dict(self) -> dict[str, Any]:
        return dict(zip(self._names, self, strict=True))


@dataclass(frozen=True)
class Output:
    """A named output: its column, its exact companion, or the records that it stands for."""

    name: str
    column: Column
    exact: Column | None = None
    hydrate: Any = None
    text: str = ""
    scalar: bool = True
    many: Callable[[Sequence[int]], list[Any]] | None = None


@dataclass(frozen=True)
class Page:
    rows: list[ResultRow]
    next: str | None
    previous: str | None
    total: int | None = None


def chunks(rows: Iterable[Any], size: int) -> Iterator[list[Any]]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield part


class ResultColumn:
    """One output as a sequence of values."""

    def __init__(self, results: ResultSet, name: str):
        self._results, self._name = results, name

    def __iter__(self) -> Iterator[Any]:
        return iter(self._results.scalars(self._name))

    def __len__(self) -> int:
        return len(self._results)

    def floats(self) -> list[float | None]:
        return [None if v is None else float(v) for v in self._results.only(self._name, exact=False).scalars(self._name)]

    def fractions(self) -> list[Fraction | None]:
        return list(self)


class ResultSet:
    """An immutable plan; iterating it runs it."""

    def __init__(
        self,
        frame: DataFrame,
        outputs: list[Output],
        order: list[Column],
        ties: list[Column],
        limit: int | None = None,
        offset: int = 0,
        plan: str = "",
        pageable: bool = False,
        exact: bool = True,
    ):
        self._frame, self._outputs, self._order, self._ties = frame, outputs, order, ties
        self._limit, self._offset, self._plan, self._pageable, self._exact = limit, offset, plan, pageable, exact
        self._length: int | None = None

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(o.name for o in self._outputs)

    def only(self, name: str, exact: bool = True) -> ResultSet:
        kept = [o for o in self._outputs if o.name == name]
        if not kept:
            raise KeyError(name)
        return ResultSet(self._frame, kept, self._order, self._ties, self._limit, self._offset, self._plan, False, exact)

    def to_frame(self) -> DataFrame:
        """The results as a DataFrame with one column for each output."""
        frame = self._frame
        bounded = self._limit is not None or self._offset
        if self._order or bounded:
            frame = frame.orderBy(*self._order, *self._ties)  # ties make limits repeatable
        columns = [o.column.alias(o.name) for o in self._outputs]
        columns += [o.exact.alias(f"{o.name}__exact") for o in self._outputs if o.exact is not None and self._exact]
        frame = frame.select(*columns)
        if self._offset:
            frame = frame.offset(self._offset)
        return frame if self._limit is None else frame.limit(self._limit)

    def _value(self, output: Output, row: Any, records: dict[str, dict[int, Any]]) -> Any:
        if output.hydrate is not None:
            return None if row[output.name] is None else records[output.name][row[output.name]]
        if output.exact is not None and self._exact:
            text = row[f"{output.name}__exact"]
            return None if text is None else Fraction(text)
        return row[output.name]

    def _made(self, rows: Sequence[Any]) -> Iterator[ResultRow]:
        """Result rows; their records are read together, once for each output."""
        records: dict[str, dict[int, Any]] = {}
        for o in self._outputs:
            if o.hydrate is not None:
                keys = list(dict.fromkeys(r[o.name] for r in rows if r[o.name] is not None))
                found = o.many(keys) if o.many and keys else [o.hydrate(k) for k in keys]
                records[o.name] = dict(zip(keys, found, strict=True))
        return (ResultRow([self._value(o, r, records) for o in self._outputs], self.names) for r in rows)

    def __iter__(self) -> Iterator[ResultRow]:
        """Rows one partition at a time, so the driver never holds them all; records come by HYDRATED_ROWS rows."""
        for rows in chunks(self.to_frame().toLocalIterator(), HYDRATED_ROWS):
            yield from self._made(rows)

    cursor = __iter__

    def __len__(self) -> int:
        if self._length is None:
            self._length = self.to_frame().count()
        return self._length

    def __getitem__(self, at: Any) -> Any:
        if isinstance(at, slice):
            if at.step not in (None, 1) or (at.start or 0) < 0 or (at.stop is not None and at.stop < 0):
                raise ValueError("slices go forward from non-negative bounds")
            start = at.start or 0
            size = None if at.stop is None else max(0, at.stop - start)
            if self._limit is not None:
                left = max(0, self._limit - start)
                size = left if size is None else min(size, left)
            return ResultSet(self._frame, self._outputs, self._order, self._ties, size, self._offset + start, self._plan, False, self._exact)
        rows = list(self[at : at + 1])
        if not rows:
            raise IndexError(at)
        return rows[0]

    def first(self) -> ResultRow | None:
        return next(iter(self[0:1]), None)

    def one(self) -> ResultRow:
        rows = list(self[0:2])
        if len(rows) != 1:
            raise LookupError("no result" if not rows else "more than one result")
        return rows[0]

    def scalars(self, name: str | None = None) -> list[Any]:
        if name is None and len(self._outputs) != 1:
            raise ValueError("name the output: there is more than one")
        chosen = self.only(name or self._outputs[0].name, self._exact)
        return [r[0] for r in chosen]

    def column(self, name: str) -> ResultColumn:
        self.only(name)
        return ResultColumn(self, name)

    def page(
        self, *, size: int, order_by: Sequence[PageOrder] = (), cursor: str | None = None, include_total: bool = False
    ) -> Page:
        """A keyset page: rows after (or before) the anchor in ``cursor``.

        Reads at most ``size`` + 1 rows from a top-k plan; there is no offset.
        """
        if not self._pageable:
            raise ValueError("pages need one record variable and no sort, limit or offset")
        if not 1 <= size <= MOST_ROWS:
            raise ValueError(f"a page has 1 to {MOST_ROWS} rows")
        if len(order_by) > MOST_KEYS or len({o.field for o in order_by}) < len(order_by):
            raise ValueError("too many or repeated sort keys")
        by_name = {o.name: o for o in self._outputs}
        if unknown := [o.field for o in order_by if o.field not in by_name or not by_name[o.field].scalar]:
            raise ValueError(f"not scalar outputs: {unknown}")
        keys = [(by_name[o.field].column, o) for o in order_by] + [(self._ties[0], PageOrder("sid"))]
        plan = paging.fingerprint(self._plan, [(o.field, o.descending, o.nulls) for o in order_by], self.names)
        backward, anchor = paging.decode(cursor, plan, len(keys)) if cursor is not None else (False, None)
        frame = self._frame
        if anchor is not None:
            frame = frame.filter(beyond(keys, anchor, backward))
        frame = frame.orderBy(*[directed(c, o, backward) for c, o in keys])
        columns = [c.alias(f"_q_key{i}") for i, (c, _) in enumerate(keys)]
        outputs = [o.column.alias(o.name) for o in self._outputs]
        outputs += [o.exact.alias(f"{o.name}__exact") for o in self._outputs if o.exact is not None]
        got = frame.select(*outputs, *columns).limit(size + 1).collect()
        more, got = len(got) > size, got[:size]
        if backward:
            got.reverse()

        def token(row: Any, back: bool) -> str:
            return paging.encode(plan, back, [row[f"_q_key{i}"] for i in range(len(keys))])

        after, before = (cursor is not None, more) if backward else (more, cursor is not None)
        return Page(
            [r for part in chunks(got, HYDRATED_ROWS) for r in self._made(part)],
            token(got[-1], False) if got and after else None,
            token(got[0], True) if got and before else None,
            self._frame.count() if include_total else None,
        )


def directed(column: Column, order: PageOrder, backward: bool) -> Column:
    down = order.descending != backward
    first = (order.nulls == "first") != backward
    return getattr(column, f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")()


def beyond(keys: list[tuple[Column, PageOrder]], anchor: list[Any], backward: bool) -> Column:
    """Rows strictly after the anchor in the (perhaps inverted) order."""
    out = F.lit(False)
    for (column, order), value in reversed(list(zip(keys, anchor, strict=True))):
        null_first = (order.nulls == "first") != backward
        if value is None:
            after = column.isNotNull() if null_first else F.lit(False)
            same = column.isNull()
        else:
            down = order.descending != backward
            after = F.coalesce(column < F.lit(value) if down else column > F.lit(value), F.lit(False))
            if not null_first:
                after = after | column.isNull()
            same = F.coalesce(column == F.lit(value), F.lit(False))
        out = after | (same & out)
    return out

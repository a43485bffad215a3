"""The search builder."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.results import Output, ResultSet
from quarry.plans.expr import Collection, Predicate, Reference, Source, Value, Variable, instant
from quarry.plans.lower import build
from quarry.plans.relation import Relation


class Searcher:
    """Collects variables, predicates, outputs and order; ``results()`` freezes them.

    ``as_of`` is a cutoff column or literal in the unit of the relations'
    timestamps; ``only_latest`` keeps the last record of each lineage.
    """

    def __init__(self, as_of: Column | Any | None = None, only_latest: bool = False):
        self._as_of = as_of if as_of is None or isinstance(as_of, Column) else F.lit(as_of)
        self._only_latest = only_latest
        self._text = [f"as_of={as_of}", f"only_latest={only_latest}"]
        self._variables: list[Source] = []
        self._predicates: list[Predicate] = []
        self._outputs: list[Output] = []
        self._atoms: list = []
        self._order: list[Column] = []
        self._limit: int | None = None
        self._offset = 0

    def variable(self, relation: Relation) -> Variable:
        source = Source(relation, f"{relation.name}{len(self._variables)}")
        self._variables.append(source)
        return Variable(source)

    def add(self, predicate: Predicate) -> Searcher:
        if not isinstance(predicate, Predicate):
            raise TypeError(f"not a predicate: {predicate!r}")
        self._predicates.append(predicate)
        return self

    def output(self, what: Any, name: str) -> Searcher:
        if any(o.name == name for o in self._outputs):
            raise ValueError(f"two outputs named {name}")
        if isinstance(what, Variable):
            source = what._source
            made = Output(name, source.key, None, source.relation.hydrate, source.label, False, source.relation.hydrate_many)
        elif isinstance(what, Reference):
            target = what._owner.relation.references[what._name][1]()
            made = Output(name, what._key, None, target.hydrate, what._text, False, target.hydrate_many)
        elif isinstance(what, Value):
            self._atoms += what._atoms
            made = Output(name, what._shown, what._exact, None, what._text, not what._atoms and len(what._sources) == 1)
        elif isinstance(what, Collection):
            raise ValueError("a collection can't be an output; it comes with its record")
        else:
            raise TypeError(f"not an output: {what!r}")
        self._outputs.append(made)
        return self

    def add_sort(self, value: Value, descending: bool = False) -> Searcher:
        """A further sort key, nulls last either way; the first is the most significant."""
        self._atoms += value._atoms
        self._order.append(value._column.desc_nulls_last() if descending else value._column.asc_nulls_last())
        self._text.append(f"sort {value._text} {descending}")
        return self

    def set_limit(self, n: int) -> Searcher:
        self._limit = None if n < 0 else n
        return self

    def add_offset(self, n: int) -> Searcher:
        self._offset += n
        return self

    @property
    def offset(self) -> int:
        return self._offset

    def frame(self) -> DataFrame:
        """All matches with all columns of all variables, unordered."""
        if not self._variables:
            raise ValueError("a search needs a variable")
        return build(self._variables, self._predicates, self._as_of, self._only_latest, self._atoms)

    def count(self) -> int:
        """Number of matches, without regard to limit and offset."""
        return self.frame().count()

    def results(self, **outputs: Any) -> ResultSet:
        for name, what in outputs.items():
            self.output(what, name)
        if not self._outputs:
            raise ValueError("a search needs an output")
        ties = [s.key for s in self._variables]
        root = {s for s in self._variables}
        pageable = len(self._variables) == 1 and not self._order and self._limit is None and not self._offset
        text = repr([self._text, [p.text for p in self._predicates], [s.relation.name for s in self._variables], [o.text for o in self._outputs]])
        import re

        plan = re.sub(r"q\d+_", "", text)
        return ResultSet(self.frame(), list(self._outputs), list(self._order), ties, self._limit, self._offset, plan, pageable and bool(root))

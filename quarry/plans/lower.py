"""From predicates to DataFrames: reference joins, atoms, variable joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.expr import Atom, Predicate, Source
from quarry.plans.spread import spread_join


def source_frame(source: Source, as_of: Column | None, only_latest: bool) -> DataFrame:
    """The rows of a root variable."""
    relation = source.relation
    frame = relation.frame()
    if as_of is not None and relation.timestamp:
        frame = frame.filter(F.col(relation.timestamp) <= as_of)
    if only_latest and relation.logical:
        newest = Window.partitionBy(relation.logical).orderBy(F.desc(relation.key))
        frame = frame.withColumn("_q_rank", F.row_number().over(newest)).filter("_q_rank = 1").drop("_q_rank")
    return source.renamed(frame)


def with_references(frame: DataFrame, source: Source, as_of: Column | None) -> DataFrame:
    """``frame`` left-joined to all reference paths of ``source`` that expressions have touched."""
    for name, target in source.references.items():
        if name == "*":
            continue
        rows = target.renamed(target.relation.frame())
        met = source.column(source.relation.references[name][0]) == target.key
        if as_of is not None and target.relation.timestamp:
            met = met & (target.column(target.relation.timestamp) <= as_of)
        frame = with_references(frame.join(rows, met, "left"), target, as_of)
    return frame


def child_rows(atom: Atom, as_of: Column | None) -> tuple[DataFrame, str]:
    """Rows of an atom's scope, and their parent key column."""
    scope = atom.scope
    if scope.child is None:
        rows, parent = scope.renamed(scope.relation.frame()), f"{scope.tag}{scope.link}"
        if as_of is not None and scope.relation.timestamp:
            rows = rows.filter(scope.column(scope.relation.timestamp) <= as_of)
        rows = with_references(rows, scope, as_of)
    elif scope.child.inline is not None:
        owner = scope.parent.relation
        element = scope.child.value or "value"
        rows = owner.frame().select(F.col(owner.key).alias("parent"), F.posexplode(scope.child.inline).alias("index", element))
        if rows.schema[element].dataType.typeName() == "struct":
            rows = rows.select("parent", "index", f"{element}.*")
        rows, parent = scope.renamed(rows), f"{scope.tag}parent"
    else:
        rows, parent = scope.renamed(scope.child.frame()), f"{scope.tag}{scope.child.parent_key}"
    target = scope.references.get("*")
    if target is not None:
        records = target.renamed(target.relation.frame())
        rows = rows.join(records, scope.column(scope.child.value) == target.key)
        rows = with_references(rows, target, as_of)
    return rows, parent


def scope_rows(atom: Atom, as_of: Column | None) -> tuple[DataFrame, str]:
    """Rows of an atom's scope with the atoms of its condition, and their parent key column."""
    rows, parent = child_rows(atom, as_of)
    scope = atom.scope
    own = [a for a in atom.condition.atoms if a.owner in set(scope.walk())]
    rows = with_atoms(rows, own, as_of)
    for sibling in (a for a in atom.condition.atoms if a not in own):
        rows = with_sibling(rows, parent, sibling, as_of)
    return rows, parent


def passing_rows(atom: Atom, as_of: Column | None) -> tuple[DataFrame, str, Column]:
    """Rows of an atom's scope that satisfy what its condition says of them alone, their parent key, and the rest of it."""
    rows, parent = child_rows(atom, as_of)
    mine, rest = set(atom.scope.walk()), F.lit(True)
    aggregated = []
    for c in atom.condition.conjuncts():
        if not c.atoms and not c.sources <= mine:
            rest = rest & c.column  # on rows of a sibling, too
        elif not c.atoms:
            rows = rows.filter(c.column)
        elif joinable(c) and c.test[0].owner in mine:
            rows = tested(rows, c.test[0].owner.key, c.test, as_of)
        elif joinable(c) and c.sources <= mine | {atom.owner}:
            rows = tested(rows, F.col(parent), c.test, as_of)  # another collection of the same parent
        else:
            aggregated.append(c)
    if aggregated:
        atoms = [a for c in aggregated for a in c.atoms]
        rows = with_atoms(rows, [a for a in atoms if a.owner in mine], as_of)
        for sibling in (a for a in atoms if a.owner not in mine):
            rows = with_sibling(rows, parent, sibling, as_of)
        for c in aggregated:
            rows = rows.filter(c.column)
    return rows, parent, rest


def joinable(predicate: Predicate) -> bool:
    """Whether a predicate is a test that a semi-join can make."""
    return predicate.test is not None and not any(c.by_python for c in predicate.test[0].condition.conjuncts())


def tested(frame: DataFrame, key: Column, test: tuple[Atom, bool], as_of: Column | None) -> DataFrame:
    """Rows of ``frame`` for whose ``key`` an atom's scope has, or has no, row that passes: a semi- or anti-join."""
    atom, wanted = test
    rows, parent, rest = passing_rows(atom, as_of)
    return frame.join(rows, (key == F.col(parent)) & rest, "left_semi" if wanted else "left_anti")


def with_sibling(rows: DataFrame, parent: str, atom: Atom, as_of: Column | None) -> DataFrame:
    """An atom of another collection of the same parent, whose condition may refer to ``rows``."""
    others, other_parent = scope_rows(atom, as_of)
    numbered = rows.withColumn("_q_row", F.struct(*rows.columns))
    met = numbered.join(others, F.col(parent) == F.col(other_parent))
    value = atom.aggregate(atom.condition.column).alias(atom.name)
    found = met.groupBy(F.xxhash64("_q_row").alias("_q_hash"), F.col("_q_row").alias("_q_same")).agg(value)
    joined = numbered.join(found, (F.xxhash64("_q_row") == F.col("_q_hash")) & F.col("_q_row").eqNullSafe(F.col("_q_same")), "left")
    return joined.drop("_q_row", "_q_hash", "_q_same").withColumn(atom.name, F.coalesce(atom.name, F.lit(atom.empty)))


def with_atoms(frame: DataFrame, atoms: Iterable[Atom], as_of: Column | None) -> DataFrame:
    """``frame`` with a column for each atom; those over one plain child table share an aggregation."""
    groups: dict[object, list[Atom]] = {}
    for atom in dict.fromkeys(atoms):
        plain = atom.scope.child is not None and not atom.condition.atoms and not atom.scope.references
        groups.setdefault((atom.owner, atom.scope.child.name) if plain else atom, []).append(atom)
    for group in groups.values():
        first = group[0]
        rows, parent = scope_rows(first, as_of)
        values = [first.aggregate(first.condition.column).alias(first.name)]
        for other in group[1:]:
            # The same child table under another tag: its columns are added under that tag, too.
            rows = rows.withColumns({c.replace(first.scope.tag, other.scope.tag, 1): F.col(c) for c in rows.columns if c.startswith(first.scope.tag)})
            values.append(other.aggregate(other.condition.column).alias(other.name))
        key = f"_q_parent_{first.name}"
        found = rows.groupBy(F.col(parent).alias(key)).agg(*values)
        frame = frame.join(found, first.owner.key == F.col(key), "left").drop(key)
        frame = frame.withColumns({a.name: F.coalesce(a.name, F.lit(a.empty)) for a in group})
    return frame


def build(
    variables: list[Source], predicates: list[Predicate], as_of: Column | None = None, only_latest: bool = False, more: Iterable[Atom] = ()
) -> DataFrame:
    """Rows of all ``variables`` that satisfy all ``predicates``.

    Conjuncts on one variable filter it before any join; those on several become
    join conditions; variables that nothing connects are crossed.  Joins on no
    side's key are dealt out by the pairs that they meet, for which rows are counted.
    """
    conjuncts = [c for p in predicates for c in p.conjuncts()]
    home = {s: v for v in variables for s in v.walk()}
    more = list(more)

    def roots(p: Predicate) -> set[Source]:
        return {home[s] for s in p.sources if s in home}

    def equated(p: Predicate, variable: Source) -> tuple[Column, Column] | None:
        """The columns of others and of ``variable`` that a predicate equates."""
        sides = [(column, {home.get(s) for s in sources}) for column, sources in p.equal or ()]
        for (mine, of_mine), (other, of_others) in (sides, sides[::-1]) if sides else ():
            if of_mine == {variable} and of_others and variable not in of_others:
                return other, mine
        return None

    out, placed = None, set()
    for variable in variables:
        frame = with_references(source_frame(variable, as_of, only_latest), variable, as_of)
        own = [c for c in conjuncts if roots(c) <= {variable} and c.sources]
        for c in own:
            if not c.atoms:
                frame = frame.filter(c.column)
        joined = [c for c in own if joinable(c)]
        for c in joined:
            frame = tested(frame, c.test[0].owner.key, c.test, as_of)
        atoms = [a for c in conjuncts if c not in joined for a in c.atoms if home.get(a.owner) is variable]
        frame = with_atoms(frame, [*atoms, *(a for a in more if home.get(a.owner) is variable)], as_of)
        for c in own:
            if c.atoms and c not in joined:
                frame = frame.filter(c.column)
        placed.add(variable)
        if out is None:
            out = frame
            continue
        linking = [c for c in conjuncts if variable in roots(c) and len(roots(c)) > 1 and roots(c) <= placed]
        met = None
        for c in linking:
            met = c.column if met is None else met & c.column
        keys = [pair for c in linking if (pair := equated(c, variable))]
        before = [v.key for v in variables if v in placed and v is not variable]
        unique = {(1, str(variable.key))} | ({(0, str(before[0]))} if len(before) == 1 else set())
        if any((side, str(pair[side])) in unique for pair in keys for side in (0, 1)):
            out = out.join(frame, met)
        else:
            out = spread_join(out, frame, met, before, [variable.key], keys)
    for c in conjuncts:
        if not c.sources:
            out = out.filter(c.column)
    return out

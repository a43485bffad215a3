"""Joins whose result is far larger than their inputs, dealt out to tasks by the pairs that they meet."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of rows that a cell meets at most, and a task on average.
CELL_PAIRS, TASK_PAIRS = 1 << 22, 1 << 23
#: Pairs for each row of the inputs from which copies of rows cost little beside them.
PAIRS_PER_ROW = 16
#: Copies of rows that a task makes.
TASK_COPIES = 1 << 20


class Load(NamedTuple):
    """Pairs that a join meets, and rows of its sides, in all and in the largest group."""

    pairs: float
    left: int
    right: int
    most_left: int
    most_right: int


def load(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]]) -> Load:
    """What a join on equal ``keys`` meets, by counts of each group; without keys all rows are one group."""
    names = [f"_q_k{i}" for i in range(len(keys))]

    def groups(rows: DataFrame, columns: Sequence[Column], n: str) -> DataFrame:
        named = rows.select(*[c.alias(k) for c, k in zip(columns, names, strict=True)])
        return named.groupBy(*names).agg(F.count(F.lit(1)).alias(n))

    lefts, rights = groups(left, [k[0] for k in keys], "_q_n"), groups(right, [k[1] for k in keys], "_q_m")
    met = lefts.join(rights, names) if keys else lefts.crossJoin(rights)
    n, m = F.col("_q_n"), F.col("_q_m")
    found = met.agg(F.sum(n.cast("double") * m), F.sum(n), F.sum(m), F.max(n), F.max(m)).first()
    return Load(*[v or 0 for v in found])


def known(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def spread_join(
    left: DataFrame,
    right: DataFrame,
    met: Column | None,
    left_ids: Sequence[Column],
    right_ids: Sequence[Column],
    keys: Sequence[tuple[Column, Column]] = (),
) -> DataFrame:
    """The inner join of ``left`` and ``right`` where ``met``, or all pairs; ``met`` implies equal ``keys``.

    Rows are counted; if pairs are few, in all or for each row, Spark joins as it likes.
    Else each side is cut into blocks by a hash of its ids, each row is copied
    for each block of the other side, and each pair meets once, in the cell of its two blocks:
    no side is broadcast, and the pairs of a task don't grow with the input.
    """
    size = load(left, right, keys)
    if size.pairs <= max(TASK_PAIRS, PAIRS_PER_ROW * (size.left + size.right)):
        return left.crossJoin(right) if met is None else left.join(right, met)
    left_keys, right_keys = [k[0] for k in keys], [k[1] for k in keys]
    kinds = [[kind for _, kind in frame.select(*own).dtypes] for frame, own in ((left, left_keys), (right, right_keys))]
    if kinds[0] == kinds[1] and {"float", "double"} & set(kinds[0]):
        # By floats Spark would exchange the rows once more, into few tasks. A hash is one for all zeros, and for all NaNs.
        left = left.filter(known(left_keys)).withColumn("_q_left_key", F.xxhash64(*left_keys))
        right = right.filter(known(right_keys)).withColumn("_q_right_key", F.xxhash64(*right_keys))
        left_keys, right_keys = [F.col("_q_left_key")], [F.col("_q_right_key")]
        met = (left_keys[0] == right_keys[0]) & F.coalesce(met, F.lit(False))
    high = min(size.most_left, CELL_PAIRS // min(size.most_right, math.isqrt(CELL_PAIRS)))
    wide = min(size.most_right, CELL_PAIRS // high)
    rows, columns = math.ceil(size.most_left / high), math.ceil(size.most_right / wide)
    tasks = math.ceil(size.pairs / TASK_PAIRS)

    def dealt(frame: DataFrame, n: int, ids: Sequence[Column], own_keys: Sequence[Column], tag: str, axis: str, blocks: int, copies: int) -> DataFrame:
        """``frame`` with its block on its own ``axis``, copied for each block on the other one."""
        frame = frame.repartition(min(tasks, math.ceil(n * copies / TASK_COPIES)), *ids)
        across = "column" if axis == "row" else "row"
        own = F.pmod(F.xxhash64(*ids), F.lit(blocks)).cast("int").alias(f"{tag}{axis}")
        frame = frame.select("*", own, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(f"{tag}{across}"))
        return frame.repartition(tasks, *own_keys, f"{tag}row", f"{tag}column")

    left = dealt(left, size.left, left_ids, left_keys, "_q_left_", "row", rows, columns)
    right = dealt(right, size.right, right_ids, right_keys, "_q_right_", "column", columns, rows)
    cell = (F.col("_q_left_row") == F.col("_q_right_row")) & (F.col("_q_left_column") == F.col("_q_right_column"))
    # Merged, as copies in a broadcast would have no bound.
    joined = left.join(right.hint("merge"), cell if met is None else cell & met)
    return joined.drop(*[f"_q_{side}_{axis}" for side in ("left", "right") for axis in ("row", "column", "key")])

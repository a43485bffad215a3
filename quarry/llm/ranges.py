"""Splitters from weighted samples, and range numbers by binary search.

Ranges are at most MOST_RANGES, so samples on the driver and bounds in plans stay
within some MB; beyond that ranges get larger instead.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_RANGES = 16_384
KINDS = {int: "array<bigint>", float: "array<double>", str: "array<string>"}


def literals(values: Sequence) -> Column:
    """A constant array of one literal, however many numbers or strings it holds."""
    return F.from_json(F.lit(json.dumps(list(values))), KINDS[type(values[0])])


def weighted_sample(df: DataFrame, keys: Sequence[str], weight: str, size: int, seed: int = 7) -> list[tuple]:
    """About ``size`` rows' keys with their weights, sampled in proportion to weight.

    A row is drawn if a hash of its key falls below ``weight * size / total``, so
    reruns draw the same rows.  Rows heavier than ``total / size`` are always
    drawn; they number ``size`` at most, which bounds the result.  Each draw
    stands for ``max(weight, total / size)``.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return []
    step = max(1.0, total / size)
    dice = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    stands_for = F.greatest(F.col(weight).cast("double"), F.lit(step))
    drawn = df.filter(F.col(weight) / F.lit(step) > dice).select(*keys, stands_for.alias("_q_weight"))
    return sorted((tuple(r)[:-1], r[-1]) for r in drawn.collect())


def splitters(sample: list[tuple], parts: int) -> list[tuple]:
    """Quantile boundaries of a sorted weighted sample: at most ``parts - 1`` distinct keys."""
    share, seen, out = sum(w for _, w in sample) / max(parts, 1), 0.0, []
    due = share
    for key, weight in sample:
        if seen >= due and (not out or key > out[-1]):
            out.append(key)
            while seen >= due:
                due += share
        seen += weight
    return out[: parts - 1]


def range_of(keys: Sequence[Column], bounds: list[tuple]) -> Column:
    """Number of the range of a row: how many of the sorted ``bounds`` its keys reach.

    A binary search over literal arrays: log2(len(bounds)) steps for each row.
    """
    if not bounds:
        return F.lit(0)
    columns = [literals([b[k] for b in bounds]) for k in range(len(keys))]

    def reaches(at: Column) -> Column:
        out = F.lit(True)
        for key, values in reversed(list(zip(keys, columns, strict=True))):
            bound = F.get(values, at)
            out = (key > bound) | ((key == bound) & out)
        return out

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(found: Column, width: Column) -> Column:
        ahead = found + width
        return F.when((ahead <= F.lit(len(bounds))) & reaches(ahead - 1), ahead).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)

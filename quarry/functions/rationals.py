"""Exact rational predicates over text such as ``-5/4``, by Arrow batches."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.BooleanType())
def scaled_equal(left: pd.Series, left_factor: pd.Series, right: pd.Series, right_factor: pd.Series) -> pd.Series:
    """left * left_factor = right * right_factor without rounding; null if any is null."""

    def equal(a: str | None, p: str | None, b: str | None, q: str | None) -> bool | None:
        if a is None or p is None or b is None or q is None:
            return None
        return Fraction(a) * Fraction(p) == Fraction(b) * Fraction(q)

    return pd.Series([equal(*r) for r in zip(left, left_factor, right, right_factor, strict=True)], dtype=object)

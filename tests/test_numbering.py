"""Dense numbers by ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dataflow


@pytest.mark.parametrize("parts", [1, 2, 7, 300])
def test_numbers_are_dense_in_order(spark, parts):
    keys = random.Random(parts).sample(range(-(1 << 40), 1 << 40), 1500)
    rows = spark.createDataFrame([(k, str(k)) for k in [*keys, None]], "key long, text string")
    numbered = dataflow.dense_numbers(rows, "key", "n", parts=parts)
    assert {r.key: r.n for r in numbered.collect()} == {k: i for i, k in enumerate([*sorted(keys), None], 1)}
    assert {r.n for r in numbered.filter("key is null").collect()} == {1501}


def test_any_number_type_is_a_key(spark):
    rows = spark.range(400).selectExpr("cast(id as int) i", "id / 8 - 9 x", "cast(id - 7 as decimal(12,3)) d", "timestamp_seconds(id) t", "date_add(date '2024-01-01', cast(id as int)) y")
    rows = rows.withColumn("x", F.when(F.col("i") == 399, float("nan")).otherwise(F.col("x")))
    for key in rows.columns:
        assert {r.i: r.n for r in dataflow.dense_numbers(rows, key, "n", parts=9).collect()} == {i: i + 1 for i in range(400)}, key


def test_a_row_is_not_compared_with_each_bound(spark):
    rows = spark.range(2000).withColumnRenamed("id", "key")
    plan = dataflow.dense_numbers(rows, "key", "n", parts=400)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" > ") < 20

"""Joins whose result is far larger than their inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators.searcher import Searcher
from quarry.plans import spread
from quarry.plans.relation import relation_of_frame


def things(spark, rows):
    frame = spark.createDataFrame(rows, "id long, level double, kind int").coalesce(1)
    return relation_of_frame("things", lambda: frame, "id")


def fullest(frame):
    """Rows of the fullest partition, and of all."""
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    return max(sizes), sum(sizes)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(spread, "CELL_PAIRS", 1 << 8)
    monkeypatch.setattr(spread, "TASK_PAIRS", 1 << 10)
    monkeypatch.setattr(spread, "PAIRS_PER_ROW", 1)


ROWS = [(i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i * 37 % 50), i % 3 or None) for i in range(120)]
OTHERS = ROWS[:40]


def test_an_inequality_is_met_by_many_tasks(spark):
    relation = things(spark, [(i, float(i * 7919 % 4000), 0) for i in range(4000)])
    s = Searcher()
    a, b = s.variable(relation), s.variable(relation)
    most, total = fullest(s.add(a.level < b.level).results(one=a, two=b).to_frame())
    assert total == 4000 * 3999 // 2 and most <= 0.8 * total


def test_pairs_of_an_inequality_are_whole(spark, small):
    def over(x, y):  # as Spark orders: NaN over all numbers
        return x is not None and y is not None and (y == y and (x != x or x > y))

    s = Searcher()
    a, b = s.variable(things(spark, ROWS)), s.variable(things(spark, OTHERS))
    found = s.add(a.level > b.level).results(one=a, two=b).to_frame()
    assert found.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, found.collect())) == sorted((x[0], y[0]) for x in ROWS for y in OTHERS if over(x[1], y[1]))


def test_products_are_whole(spark, small):
    s = Searcher()
    a, b, c = s.variable(things(spark, OTHERS)), s.variable(things(spark, OTHERS)), s.variable(things(spark, OTHERS[:5]))
    found = s.add(a.id != b.id).results(one=a, two=b, three=c).to_frame()
    assert found.count() == found.distinct().count() == 40 * 39 * 5
    s = Searcher()
    s.variable(things(spark, ROWS)), s.variable(things(spark, []))
    assert s.count() == 0


def test_few_groups_are_met_by_many_tasks(spark):
    relation = things(spark, [(i, 0.0, i % 2) for i in range(4600)])
    s = Searcher()
    a, b = s.variable(relation), s.variable(relation)
    most, total = fullest(s.add(a.kind == b.kind).add(a.id != b.id).results(one=a, two=b).to_frame())
    assert total == 2 * 2300 * 2299 and most <= 0.8 * total


def test_pairs_of_groups_are_whole(spark, small):
    s = Searcher()
    a, b = s.variable(things(spark, ROWS)), s.variable(things(spark, OTHERS))
    found = s.add(b.kind == a.kind).add(a.level == b.level).results(one=a, two=b).to_frame()
    same = sorted((x[0], y[0]) for x in ROWS for y in OTHERS if x[2] == y[2] and x[2] and x[1] is not None and (x[1] == y[1] or y[1] is not None and x[1] != x[1] and y[1] != y[1]))
    assert sorted(map(tuple, found.collect())) == same
    s = Searcher()
    a, b = s.variable(things(spark, ROWS)), s.variable(things(spark, OTHERS))
    found = s.add(b.kind == a.kind).results(one=a, two=b).to_frame()
    assert found.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, found.collect())) == sorted((x[0], y[0]) for x in ROWS for y in OTHERS if x[2] and x[2] == y[2])


def test_joins_on_a_key_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(spread, "load", None)
    s = Searcher()
    a, b = s.variable(things(spark, ROWS)), s.variable(things(spark, OTHERS))
    assert s.add(a.kind == b.sid).results(one=a, two=b).to_frame().count() == sum(r[2] is not None for r in ROWS)


def test_groups_of_floats_are_met_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_PAIRS", 1 << 17)
    monkeypatch.setattr(spread, "CELL_PAIRS", 1 << 14)
    level = [0.0, -0.0, float("nan"), None]
    relation = things(spark, [(i, level[i % 4], i % 3 or None) for i in range(1200)])
    s = Searcher()
    a, b = s.variable(relation), s.variable(relation)
    most, total = fullest(s.add(a.level == b.level).results(one=a, two=b).to_frame())
    assert total == 600**2 + 300**2 and most <= 0.8 * total
    s = Searcher()
    a, b = s.variable(relation), s.variable(relation)
    assert s.add(a.kind == b.kind).add(a.level == b.level).count() == 2 * (200**2 + 100**2)

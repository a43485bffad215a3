"""Tables of relational databases as relations, read in parallel by JDBC.

The database's driver must be on Spark's class path.  Filters and columns are
pushed to the database; reads are split by ranges of a numeric key.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.relation import Relation, relation_of_frame

#: Rows of one partition of a split read, about.
PARTITION_ROWS = 500_000


def jdbc_frame(spark: SparkSession, url: str, table: str, *, split_by: str | None = None, options: Mapping[str, Any] | None = None) -> DataFrame:
    """A database's table (or query in parentheses with an alias).

    With ``split_by``, a numeric column, one small query asks for its bounds and the
    number of rows, and the read is split into as many ranges as these rows need.
    """
    reader = spark.read.format("jdbc").options(url=url, **dict(options or {}))
    if split_by is None:
        return reader.option("dbtable", table).load()
    asked = f"(SELECT MIN({split_by}) AS low, MAX({split_by}) AS high, COUNT(*) AS n FROM {table}) bounds"
    low, high, n = reader.option("dbtable", asked).load().first()
    if not n or low is None:
        return reader.option("dbtable", table).load()
    parts = {"partitionColumn": split_by, "lowerBound": int(low), "upperBound": int(high) + 1}
    return reader.option("dbtable", table).options(numPartitions=-(-n // PARTITION_ROWS), **parts).load()


def jdbc_relation(name: str, spark: SparkSession, url: str, table: str, key: str, *, split_by: str | None = None, options: Mapping[str, Any] | None = None, **parts: Any) -> Relation:
    """A relation over a database's table; ``parts`` are those of relation_of_frame()."""
    return relation_of_frame(name, lambda: jdbc_frame(spark, url, table, split_by=split_by, options=options), key, **parts)

"""Set-wise steps of ingest and integrity checks, on any DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of canonical JSON of ``columns``; null and empty differ, and field borders are kept."""
    named = F.struct(*[c.alias(f"f{i}") for i, c in enumerate(columns)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def with_content_id(rows: DataFrame, fields: Sequence[str], name: str = "content_id") -> DataFrame:
    return rows.withColumn(name, content_hash([F.col(f) for f in fields]))


def canonical_map(rows: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """(sid, canonical_sid): the smallest key among rows of equal identity, nulls equal.

    Aggregated before it is joined back, so a hot identity is folded map-side and
    the join back can be split where it is skewed.
    """
    ids = rows.select(F.col(key).alias("sid"), *[F.col(c).alias(f"_i{n}") for n, c in enumerate(identity)])
    names = [f"_i{n}" for n in range(len(identity))]
    least = ids.groupBy(*[F.col(n).alias(f"_k{n}") for n in names]).agg(F.min("sid").alias("canonical_sid"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_k{n}"))
    return ids.join(least, same).select("sid", "canonical_sid")


def metadata_conflicts(rows: DataFrame, identity: str, metadata: Sequence[str]) -> DataFrame:
    """Identities whose rows disagree in ``metadata``; null differs from a value, NaN from everything."""
    cells = [F.when(F.isnan(c), F.concat(F.lit("nan "), F.uuid())) for c in metadata if dict(rows.dtypes)[c] in ("double", "float")]
    cells = {c: v for c, v in zip([c for c in metadata if dict(rows.dtypes)[c] in ("double", "float")], cells, strict=True)}
    seen = F.struct(*[F.coalesce(cells[c], F.col(c).cast("string")).alias(c) if c in cells else F.col(c) for c in metadata])
    distinct = rows.select(identity, seen.alias("seen")).distinct()
    return distinct.groupBy(identity).agg(F.count(F.lit(1)).alias("versions")).filter("versions > 1")


def unreferenced(rows: DataFrame, key: str, others: DataFrame, foreign: str) -> DataFrame:
    """Rows whose key no row of ``others`` refers to."""
    keys = others.select(F.col(foreign).alias("_q_foreign"))
    return rows.join(keys, F.col(key) == F.col("_q_foreign"), "left_anti")


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def followed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct targets of edges (source, target) that start in ``nodes`` (sid)."""
    return edges.join(nodes, F.col("source") == F.col("sid"), "left_semi").select(F.col("target").alias("sid")).distinct()


def reachable(roots: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """All nodes that edges (source, target) reach from ``roots`` (sid), by a frontier that grows until it is empty.

    ``checkpoint`` writes a frame and returns it reread, so plans stay short in long chains.
    """
    seen = checkpoint(roots.select("sid").distinct())
    frontier = seen
    while not frontier.isEmpty():
        frontier = checkpoint(followed(frontier, edges).join(seen, "sid", "left_anti"))
        seen = checkpoint(seen.unionByName(frontier))
    return seen


def bounds_below(key: Column, bounds: Column, n: int) -> Column:
    """How many of ``n`` sorted ``bounds``, an array, are below ``key``; all if it is null.

    A binary search: log2(n) steps for each row, and an expression of one size for any ``n``.
    """
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(found: Column, width: Column) -> Column:
        ahead = found + width
        return F.when((ahead <= n) & (key.isNull() | (key > F.get(bounds, ahead - 1))), ahead).otherwise(found)

    return F.aggregate(widths, F.lit(0), step)


def dense_numbers(rows: DataFrame, key: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with dense numbers 1..n in the order of the unique ``key``, nulls last.

    Range-partitioned by key; each partition numbers its own rows, and a table of
    one row per partition gives the offsets.  No task sees all rows.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bounds = sorted({b for b in bounds or [] if b == b})
    slot = F.lit(0)
    if bounds:
        array = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{dict(rows.dtypes)[key]}>")
        slot = F.coalesce(bounds_below(F.col(key), array, len(bounds)), slot)  # never null, so the join needs no filter
    placed = rows.withColumn("_q_part", slot)
    counts = placed.groupBy("_q_part").agg(F.count(F.lit(1)).alias("_q_n"))
    before = Window.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_q_part", F.coalesce(F.sum("_q_n").over(before), F.lit(0)).alias("_q_first"))
    own = F.row_number().over(Window.partitionBy("_q_part").orderBy(F.col(key).asc_nulls_last()))
    out = placed.withColumn("_q_own", own).join(F.broadcast(first), "_q_part")
    return out.withColumn(name, (F.col("_q_first") + F.col("_q_own")).cast("long")).drop("_q_part", "_q_own", "_q_first")

"""Sharding by sampled splitters into shards of nearly equal bytes.

The key of a record is (hash of its text, hash of its id), so equal texts stand
together.  Size-weighted samples of the key give quantile boundaries that cut
the key space into many ranges.  Exact sizes per range are then counted; a range
with more than twice its share (a text that a third of all rows have) is
subdivided by a second sample on the full key.  Running sums within ranges and
range offsets give each record its place in the whole order.

Units that weigh more than a small part of a shard, of which there can only be
a bounded number, are placed first, each into the emptiest shard; the order of
all other records is then cut so that every shard fills to one level.

Everything is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.ranges import MOST_RANGES, range_of, splitters, weighted_sample
from quarry.llm.storage import materialize, text_or_empty

#: A group of equal texts is placed whole up to this part of a shard's share; a larger one is divided by rows.
WHOLE_GROUP = 0.25
#: Rows of a range, about, which one task orders.
RANGE_ROWS = 500_000
LOWEST = -(1 << 63)


def balanced_ranges(base: DataFrame, total: int, ranges: int, sample: int) -> DataFrame:
    """``base`` with its range number ``part`` by sampled splitters on (h, d)."""
    keys = [F.col("h"), F.col("d")]
    bounds = [(h[0], LOWEST) for h in splitters(weighted_sample(base, ["h"], "size", sample), ranges)]
    share = max(1.0, total / ranges)
    while True:
        placed = base.withColumn("part", range_of(keys, bounds))
        full = {r[0]: r[1] for r in placed.groupBy("part").agg(F.sum("size")).collect() if r[1] > 2 * share}
        more = set()
        if full:
            inside = placed.filter(F.col("part").isin(list(full)))
            drawn = weighted_sample(inside, ["part", "h", "d"], "size", sample, seed=11)
            for part, held in full.items():
                own = [((h, d), w) for (p, h, d), w in drawn if p == part]
                more |= set(splitters(own, int(held / share) + 1))
        if not more - set(bounds):
            return placed
        bounds = sorted(set(bounds) | more)


def water_level(loads: list[float], volume: float) -> float:
    """Level to which ``volume`` fills bins that already hold ``loads``."""
    heights, held = sorted(loads), 0.0
    for n, height in enumerate(heights, 1):
        held += height
        level = (volume + held) / n
        if n == len(heights) or level <= heights[n]:
            return level
    return 0.0


def shard_by_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shards: int = 16,
    ranges: int = 128,
    sample: int = 4096,
    heavy: float = 0.005,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 length of the text plus 1; null text is 1, with the
    crc32 of the empty string.  ``shard`` is 0 to ``shards`` - 1, ``slot`` counts
    from 0 without gaps within a shard.  Rows of equal text go to one shard
    unless together they hold more than a quarter of a shard's share; such a
    group is divided row by row.  Shards then differ by about ``heavy`` of their
    share, or by one row where single rows outweigh that.  Repeated rows get slots of
    their own.  A null id is an id like any other.  An empty table gives no rows.
    Very long texts are rows like others; other columns, whatever their names, are
    not read.  There are ``ranges`` of the key space or more, by the rows.
    """
    text = text_or_empty(text_col)
    base = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ).withColumn("d", F.xxhash64("doc_id", F.lit(1))),
        "sized",
    )
    total, n_rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = max(1.0, total / shards)
    ranges = min(max(ranges, n_rows // RANGE_ROWS), MOST_RANGES)
    placed = balanced_ranges(base, total, ranges, max(sample, 32 * ranges))

    # Units above heavy * share: shards / heavy at most, so they fit the driver and a broadcast.
    groups = base.groupBy("h").agg(F.sum("size").alias("held")).filter(F.col("held") > heavy * share).collect()
    units = [(g.held, g.h, None) for g in groups if g.held <= WHOLE_GROUP * share]
    if split := [g.h for g in groups if g.held > WHOLE_GROUP * share]:
        rows = base.filter(F.col("h").isin(split)).groupBy("h", "d").agg(F.sum("size").alias("held"))
        units += [(r.held, r.h, r.d) for r in rows.filter(F.col("held") > heavy * share).collect()]
    bins = [(0, s) for s in range(shards)]
    chosen = []
    for held, h, d in sorted(units, key=lambda u: (-u[0], u[1], u[2] or 0)):
        load, shard = heapq.heappop(bins)
        heapq.heappush(bins, (load + held, shard))
        chosen.append((h, d, shard))
    loads = [load for load, _ in sorted(bins, key=lambda b: b[1])]
    level = water_level(loads, total - sum(loads))
    cuts, filled = [], 0.0
    for load in loads[:-1]:
        filled += max(0.0, level - load)
        cuts.append((filled,))

    spark = docs.sparkSession
    fixed = spark.createDataFrame(chosen, "h long, d long, fixed int")
    by_group = F.broadcast(fixed.filter("d is null").select("h", F.col("fixed").alias("of_group")))
    by_row = F.broadcast(fixed.filter("d is not null").withColumnRenamed("fixed", "of_row"))
    known = placed.join(by_group, "h", "left").join(by_row, ["h", "d"], "left")
    known = known.withColumn("fixed", F.coalesce("of_group", "of_row"))
    known = known.withColumn("light", F.when(F.col("fixed").isNull(), F.col("size")).otherwise(F.lit(0)))

    in_part = Window.partitionBy("part").orderBy("h", "d")
    group = Window.partitionBy("part", "h")
    # One row for each range, a few hundred in all.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stats = known.groupBy("part").agg(F.sum("light").alias("held"))
    offsets = stats.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    run = (
        known.withColumn("upto", F.sum("light").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("group_end", F.max("upto").over(group))
        .withColumn("group_size", F.sum("light").over(group))
        .join(F.broadcast(offsets), "part")
    )
    whole = F.col("group_size") <= F.lit(heavy * share)
    middle = F.when(whole, F.col("group_end") - F.col("group_size") / 2).otherwise(F.col("upto") - F.col("light") / 2)
    cut = range_of([F.col("start") + F.col("middle")], cuts)
    run = run.withColumn("middle", middle).withColumn("shard", F.coalesce("fixed", cut))
    run = run.withColumn("nth", F.row_number().over(Window.partitionBy("part", "shard").orderBy("h", "d")))
    run = materialize(run.select("doc_id", "size", "text_crc32", "part", "shard", "nth"), "placed")
    counts = run.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    return run.join(F.broadcast(first), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

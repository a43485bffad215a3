"""Mixing sources to target weights by capped water-filling.

Targets share a budget of words by weight.  A source's target stops at
``max_epochs`` times its size; the excess is shared by weight among the others,
again and again, until none is above its cap.  A source's documents are then all
taken a whole number of times, and a seeded part of them once more: in the order
of a seeded hash, whole buckets of documents up to the bucket in which the target is
met, and of that bucket each document that still fits what is left.

Sources may be any number; their table is never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.ranges import range_of, splitters, weighted_sample
from quarry.llm.storage import materialize, small, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and hash bucket, about; the bucket in which a target is met is filled by one task.
BUCKET_ROWS = 1_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def numbered(table: DataFrame, keys: Sequence[str], parts: int = 32) -> DataFrame:
    """``table`` with ``nth``, the number of each row in the order of ``keys``, from 0."""
    ones = table.withColumn("one", F.lit(1))
    bounds = splitters(weighted_sample(ones, keys, "one", 64 * parts), parts)
    placed = table.withColumn("part", range_of([F.col(k) for k in keys], bounds))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    out = placed.withColumn("in_part", nth).join(F.broadcast(first), "part")
    return out.withColumn("nth", F.col("first") + F.col("in_part") - 1).drop("part", "in_part", "first")


def water_filled(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size, rows) with their ``target`` words."""
    keyed = sources.withColumns({"last": F.col("source").isNull().cast("int"), "name": F.coalesce("source", F.lit(""))})
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = numbered(keyed, ["last", "name"]).withColumn("weight", F.get(cycle, F.pmod("nth", F.lit(len(weights)))))
    table = materialize(ranked.withColumn("cap", F.col("source_size") * max_epochs), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        held, n, open_weight = table.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0)), F.count_if(full), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - held) / open_weight
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return table.select("source", "source_size", "rows", target.alias("target"))


def mixing_plan(
    sized: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 20
) -> DataFrame:
    """A row per source: (source, source_size, target, whole, below, last, picks).

    A document is taken ``whole`` times, and once more if its dice() is less than
    ``below``, or up to ``last`` and one of ``picks``.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = water_filled(sources, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(epochs), F.lit(max_epochs))
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # A source's buckets follow from its own rows, whatever the others hold: 62 - shift bits number them.
    full = F.floor(F.col("rows") / BUCKET_ROWS)
    bits = F.when(full > 0, F.least(F.length(F.bin(full)), F.lit(20))).otherwise(F.lit(0))
    sources = materialize(sources.withColumn("shift", (62 - bits).cast("int")), "targets")
    n_sources = sources.count()
    shifts = sources.select(F.col("source").alias("of"), "shift")
    thrown = sized.select("source", "size", dice(F.col("doc_id"), seed).alias("u"))
    thrown = thrown.join(small(shifts, n_sources), F.col("source").eqNullSafe(F.col("of")))
    thrown = thrown.select("source", "size", "u", F.expr("shiftright(u, shift)").alias("bucket"))
    held = thrown.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    rest = sources.select(F.col("source").alias("of"), "rest", "shift")
    at = held.join(small(rest, n_sources), F.col("source").eqNullSafe(F.col("of")))
    at = at.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") >= F.col("rest")))
    below = F.expr("shiftleft(bucket, shift)")
    at = at.select("of", "bucket", below.alias("below"), (F.col("rest") - F.col("before")).alias("room"))
    at = materialize(at, "cuts")
    # Only the documents of the bucket in which a source's rest is met are ordered.
    edge = thrown.withColumnRenamed("bucket", "b").join(
        small(at, n_sources), F.col("source").eqNullSafe(F.col("of")) & (F.col("b") == F.col("bucket"))
    )
    edge = materialize(edge.filter("size > 0").groupBy("of", "u").agg(F.sum("size").alias("size")), "edge")
    # A bucket's documents are some thousands at most: they are gone through in one array.
    listed = F.sort_array(F.collect_list(F.struct("u", "size")))
    edge = edge.groupBy("of").agg(listed.alias("listed")).withColumnRenamed("of", "src")
    start = F.struct(F.col("room").cast("double").alias("room"), F.array().cast("array<bigint>").alias("picks"))

    def fill(held: Column, document: Column) -> Column:
        fits = document["size"] <= held["room"]
        return F.struct(
            (held["room"] - F.when(fits, document["size"]).otherwise(0)).cast("double").alias("room"),
            F.when(fits, F.concat(held["picks"], F.array(document["u"]))).otherwise(held["picks"]).alias("picks"),
        )

    found = at.join(edge, F.col("of").eqNullSafe(F.col("src")))
    found = found.select("of", "below", F.aggregate("listed", start, fill).getField("picks").alias("picks"))
    found = materialize(found.withColumn("last", F.array_max("picks")), "found")
    joined = sources.join(small(found, n_sources), F.col("source").eqNullSafe(F.col("of")), "left")
    every = F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.lit(1 << 62))
    return materialize(
        joined.select(
            "source", "source_size", "target", F.col("whole").cast("int"), F.coalesce("below", every).alias("below"), "last", "picks"
        ),
        "plan",
    )


def dice(doc_id: Column, seed: int) -> Column:
    """A seeded number from 0 to 2**62 - 1 for a document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 2)


def repetitions(sized: DataFrame, plan: DataFrame, seed: int, max_epochs: int) -> DataFrame:
    """``sized`` joined to its source's plan, with ``repeats``."""
    plan = plan.select(F.col("source").alias("_q_of"), "source_size", "target", "whole", "below", "last", "picks")
    joined = sized.join(small(plan, plan.count()), F.col("source").eqNullSafe(F.col("_q_of")))
    u = dice(F.col("doc_id"), seed)
    # The array is looked at for documents of the last bucket only.
    within = F.when((u >= F.col("below")) & (u <= F.col("last")), F.array_contains("picks", u))
    once_more = ((u < F.col("below")) | F.coalesce(within, F.lit(False))).cast("int")
    return joined.withColumn("repeats", F.least(F.col("whole") + once_more, F.lit(max_epochs)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, source_size, target, taken, source, repeats).

    ``size`` is the number of words, 0 for null and blank texts; such documents
    are taken like the others and add nothing.  Sources by code point, null
    last, weigh ``weights`` in turn; a null source is a source of its own.
    Taken words stay below a source's target by less than the smallest document of
    its last bucket that was left out, mostly by a few words.  A source without words
    has target 0.  Rows of equal id share their dice and count together.  An empty table gives no rows.
    Very long texts are counted whole; other columns, whatever their names, are not read.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(text_or_empty(text_col)).alias("size"),
        ),
        "sizes",
    )
    chosen = mixing_plan(sized, weights=weights, max_epochs=max_epochs, seed=seed)
    mixed = repetitions(sized, chosen, seed, max_epochs)
    taken = (F.col("repeats") * F.col("size")).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "repeats")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 20,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept, whatever their names.

    See mix() for what it takes: null text has no words, null sources are one source,
    rows of equal id are taken alike.  An empty table gives no rows.
    """
    names = docs.columns
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text_or_empty(text_col)).alias("size"),
    )
    chosen = mixing_plan(materialize(sized, "sizes"), weights=weights, max_epochs=max_epochs, seed=seed)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_q_row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text_or_empty(text_col)).alias("size"),
    )
    mixed = repetitions(rows, chosen, seed, max_epochs).filter("repeats > 0")
    repeated = mixed.select("_q_row", F.explode(F.array_repeat(F.lit(0), F.col("repeats"))).alias("_q_n"))
    return repeated.select("_q_row.*")

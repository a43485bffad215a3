"""Exact de-duplication through an extendible-hash index on shared files.

Each text is normalised by deleting ASCII white space.  Its 64-bit hash is the
index key; the index holds one entry for each distinct (hash, digest), made by
map-side aggregation, so a text that a third of all rows share costs one entry
per map task.  The directory starts with one bucket and doubles while a bucket
has more entries than its capacity.  A bucket is a range of keys; its entries are
files of their own, written and read by one owner task.

An owner finds the chains of its bucket: the entries under one hash.  Of chains that
stand for two rows or more it gets the normalised bytes, folded within each map
task, compares them, and tells how many different texts the chain has, who stays
of each, and how many rows it stands for.

Everything is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.row_verdicts import drop_lost
from quarry.llm.storage import materialize, scratch, small, text_or_empty

#: The white space that does not count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


#: Buckets, about, beyond which they hold more entries instead: each is a task and a folder.
MOST_BUCKETS = 8192


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def directory(counts: dict[int, int], max_depth: int, bucket_entries: int) -> list[int]:
    """Bucket number for each slot of the extendible-hash directory.

    ``counts`` has the number of entries for each ``max_depth``-bit prefix.  A
    bucket of local depth d covers all prefixes that share d leading bits; it
    splits in two while it is overfull, and the directory doubles whenever a
    bucket as deep as the directory splits.  The result is expanded to
    ``2 ** max_depth`` slots.
    """
    total = [0]
    for prefix in range(1 << max_depth):
        total.append(total[-1] + counts.get(prefix, 0))
    slots, buckets, open_ = [0] * (1 << max_depth), 0, [(0, 0)]
    while open_:
        depth, first = open_.pop()
        width = 1 << (max_depth - depth)
        if depth < max_depth and total[first + width] - total[first] > bucket_entries:
            open_ += [(depth + 1, first + width // 2), (depth + 1, first)]
            continue
        slots[first : first + width] = [buckets] * width
        buckets += 1
    return slots


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    bucket_entries: int = 50_000,
    max_depth: int | None = None,
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    A group has the rows whose texts are equal after deleting ASCII white space.
    The row with the most code points in its original text stays, of these the
    one with the smallest id.  Null text counts as empty, so null, empty and
    all-blank texts form one group.  A null id sorts after every other.  Rows
    that repeat an id and text count each in ``group_size`` and share the
    verdict.  Very long texts are compared whole.  An empty table gives no rows.
    Other columns, whatever their names, are not read.  The directory may double until
    it has 16 slots for each full bucket, or ``max_depth`` times.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).alias("n_chars"),
        normalised(text).alias("norm"),
    ).withColumn("h", key(F.col("norm")).cast("long"))
    rows = materialize(base.select("doc_id", "n_chars", "h", F.sha2("norm", 256).alias("sha")), "rows")

    entries = materialize(rows.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("n")), "entries")
    n_entries = entries.count()
    capacity = max(bucket_entries, n_entries // MOST_BUCKETS)
    depth = max_depth or (n_entries // capacity).bit_length() + 4
    entries = entries.withColumn("slot", F.shiftrightunsigned("h", 64 - depth).cast("int"))
    counts = {r[0]: r[1] for r in entries.groupBy("slot").count().collect()}  # 2 ** depth rows: 2 ** 18 at most
    slots = directory(counts, depth, capacity)
    owners = slots[-1] + 1
    lookup = spark.createDataFrame(list(enumerate(slots)), "slot int, bucket int")
    path = scratch(spark, "index")
    indexed = entries.join(F.broadcast(lookup), "slot").select("bucket", "h", "sha", "n")
    indexed.repartition(owners, "bucket").write.partitionBy("bucket").parquet(path)
    index = spark.read.schema("h long, sha string, n long, bucket int").parquet(path)

    # Owner tasks, one for each bucket, from here on: chains with more than one row.
    chains = index.repartition(owners, "bucket").groupBy("bucket", "h").agg(F.sum("n").alias("rows"))
    shared = materialize(chains.filter("rows > 1").select("bucket", "h"), "shared")
    n_shared = shared.count()
    order = F.col("n_chars").cast("decimal(10,0)") * F.lit(str(2**64)).cast("decimal(20,0)") - F.coalesce(
        "doc_id", F.lit(2**63 - 1)
    ).cast("decimal(19,0)")
    folded = (
        base.join(small(shared, n_shared), "h")
        .groupBy("bucket", "h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max_by("doc_id", order).alias("keep_id"))
    )
    chain = Window.partitionBy("bucket", "h")
    compared = folded.repartition(owners, "bucket").withColumn("links", F.count(F.lit(1)).over(chain))
    collided = F.when(F.col("links") > 1, F.col("norm")).alias("norm")
    compared = materialize(compared.select("h", "links", "group_size", "keep_id", collided), "compared")
    alone = compared.filter("links = 1").select("h", "group_size", "keep_id")
    matched = rows.join(small(alone, n_shared), "h", "left")
    apart = compared.filter("links > 1")
    if not apart.isEmpty():
        # Different texts under one hash: their rows are matched by the bytes.
        hashes = materialize(apart.select("h").distinct(), "collided")
        hit = small(hashes, hashes.count())
        exact = base.join(hit, "h", "left_semi").join(apart.select("h", "norm", "group_size", "keep_id"), ["h", "norm"])
        exact = exact.select("h", "doc_id", "n_chars", F.sha2("norm", 256).alias("sha"), "group_size", "keep_id")
        matched = matched.join(hit, "h", "left_anti").unionByName(exact)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return matched.select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept, whatever their names.

    Which row stays is said at exact_groups().  Null and repeated ids change nothing:
    each row counts by its own text, null text as empty; rows of equal id and text
    are one.  An empty table gives no rows.
    """

    def lost(rows: DataFrame, ids: str, texts: str) -> DataFrame:
        return exact_groups(rows, ids, texts, **options).filter(~F.col("kept")).select("doc_id")

    return drop_lost(docs, id_col, text_col, lost)

"""Dropping rows by a verdict that is keyed by ids, whatever the ids are.

Verdicts name rows by id.  Where an id is null or repeated, that would join
different documents, so such tables are numbered first: rows of equal id and
text are folded into one, and the others get a number of their own, in the order
of their ids with null last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.mixing import numbered
from quarry.llm.storage import materialize, text_or_empty, without_ids

#: Rows of a range that a single task numbers, about.
NUMBERED_ROWS = 50_000


def numbered_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_q_row, nth): one row for each id and text, null text being empty; ``_q_row`` has all columns."""
    keys = ["_q_last", "_q_id", "_q_sha"]
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_row"),
        doc_id.isNull().cast("int").alias("_q_last"),
        F.coalesce(doc_id, F.lit(0)).alias("_q_id"),
        F.sha2(text_or_empty(text_col), 256).alias("_q_sha"),
    )
    once = materialize(rows.dropDuplicates(keys), "once")
    return materialize(numbered(once, keys, max(32, once.count() // NUMBERED_ROWS)).select("_q_row", "nth"), "numbered")


def drop_lost(docs: DataFrame, id_col: str, text_col: str, lost: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose ids ``lost(docs, id_col, text_col)`` lists.

    Rows that share an id, or have none, are judged each by its text; of those
    with equal id and text one is left at most.  Only tables with such rows are
    numbered.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").count()
    if ids.filter("count > 1 OR id IS NULL").isEmpty():
        return without_ids(docs, lost(docs, id_col, text_col), id_col)
    rows = numbered_rows(docs, id_col, text_col)
    texts = rows.select("nth", F.col(f"_q_row.`{text_col}`").alias("text"))
    return without_ids(rows, lost(texts, "nth", "text"), "nth").select("_q_row.*")

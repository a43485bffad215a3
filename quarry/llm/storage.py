"""Shared working folders and size-checked joins.

Every intermediate table goes to the folder named by ``spark.checkpoint.dir``,
which driver and executors share, so a lost executor costs a re-read and not a
recomputation.  Only a session without that setting (a unit test) gets a
temporary folder of its own.  Working tables stay until the session ends, or
remove_working_tables() is called when all results are written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many bytes are broadcast; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a broadcast row beside its values, about; and of its values by type.
ROW_BYTES = 24
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}

_own_root: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _own_root[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused folder URI below the shared root; removed at exit."""
    path = f"{shared_root(spark)}/quarry-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_working_tables() -> None:
    """Delete all working tables; results that were not written yet can't be read any more."""
    while _made:
        spark, path = _made.pop()
        remove(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is None:
            continue
        try:
            remove(spark, path)
        except Exception as gone:  # the gateway may have closed before us
            print(f"left {path}: {type(gone).__name__}")
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """Hint a broadcast of ``df`` only if its counted ``rows`` take ``limit`` bytes at most.

    The bytes of columns without a fixed width are measured.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    held = rows * (ROW_BYTES + sum(WIDTHS.get(kind, 0) for _, kind in df.dtypes))
    measured = [c for c, kind in df.dtypes if kind not in WIDTHS]
    if held <= limit and measured:
        held += df.agg(F.sum(F.octet_length(F.to_json(F.struct(*measured))))).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one-column table ``ids``."""
    ids = ids.toDF("_q_id").distinct()
    gone = materialize(ids, "dropped")
    return docs.join(small(gone, gone.count()), docs[id_col] == F.col("_q_id"), "left_anti")

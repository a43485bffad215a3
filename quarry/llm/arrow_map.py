"""Python over whole columns, one Arrow batch at a time, and what workers hold between tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a slice that a function sees at once are bounded by this many bytes.
SLICE_BYTES = 8 << 20

#: Rows that travel together; Spark's own default is 10,000, which for texts of some KB
#: takes more memory of the JVM and of its workers than all that an operator keeps.
BATCH_ROWS = 2_000
_held: dict[Hashable, Any] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS, unless it has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """This worker's object of a name, made once; a worker holds one at most.

    Workers serve one operator after the other; what one of them holds must not
    take memory from the next.
    """
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Drop what this worker holds, and give freed memory back to the system where that can be asked for."""
    _held.clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes, one row at least."""
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_batches(
    df: DataFrame, schema: str, task: Callable[[], Callable[[pa.RecordBatch], dict[str, Iterable]]], limit: int = SLICE_BYTES, *, holds: bool = False
) -> DataFrame:
    """``df`` mapped by the function that ``task()`` makes once for each task.

    The function takes a slice of a batch of about ``limit`` bytes and returns columns by name.
    Without ``holds`` the task first lets go of what earlier ones of its worker hold.
    """
    bounded_batches(df.sparkSession)
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        work = task()
        for batch in batches:
            for part in slices(batch, limit):
                out = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)

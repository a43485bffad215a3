"""Small text files and atomic pointers on any Hadoop file system."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

#: Seconds after which a writer that has claimed a name without writing it counts as dead.
STALE_S = 600


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist: False if another writer was first.

    The writer that creates ``path``.claim may write; the text goes to a file of
    another name that is renamed when it is whole, so no reader sees a part of it.
    A claim that is older than STALE_S without a file is a dead writer's and goes.
    """
    fs, target = _fs(spark, path)
    if fs.exists(target):
        return False
    _, claim = _fs(spark, f"{path}.claim")
    if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_S:
        fs.delete(claim, False)
    try:
        fs.create(claim, False).close()
    except Exception:
        if fs.exists(claim) or fs.exists(target):
            return False
        raise
    if fs.exists(target):  # its writer had given its claim back
        fs.delete(claim, False)
        return False
    _, whole = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(whole, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(whole, target):
        fs.delete(whole, False)
        raise OSError(f"could not rename to {path}")
    fs.delete(claim, False)
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)

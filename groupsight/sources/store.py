"""Tables and folders in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="groupsight-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/groupsight/{uuid.uuid4().hex}/{name}"


class _Open(threading.local):
    """Paths of the tables written since each open scratch() of this thread began."""

    def __init__(self):
        self.paths: list[list[str]] = []


_SCRATCH = _Open()


def cut(df: DataFrame, name: str, with_path: bool = False):
    """Write df as a table in the shared folder and read it again, so that later work starts from files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    for paths in _SCRATCH.paths[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out, path) if with_path else out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that cut() writes inside are deleted at the end, but for those whose path is taken off the list."""
    _SCRATCH.paths.append([])
    try:
        yield _SCRATCH.paths[-1]
    finally:
        for path in _SCRATCH.paths.pop():
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written by cut()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A side of a join of up to this many rows is broadcast.
BROADCAST_ROWS = 300_000


def sized(side: DataFrame, name: str) -> DataFrame:
    """side as a table in the shared folder, to be broadcast if it has BROADCAST_ROWS rows at most, else joined by shuffle."""
    side = cut(side, name)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side

"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Where that is unset, a session on one machine (tests)
gets a temporary folder, and any other is refused: executors would not see each other's files.  A written
table cuts the lineage: a lost executor costs a re-read, not a re-run.

``drop`` deletes a table once others no longer read it; ``inside`` deletes what was made in its block, but for
the tables that are named.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_own: list[str] = []
_path_of: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="shared-"))
        base = _own[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def same(table: DataFrame, view: DataFrame) -> DataFrame:
    """view, which reads the stored table and takes its place for drop."""
    _path_of[view] = _path_of.pop(table)
    return view


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    if path in _made:
        _made.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = _path_of.pop(t, None)
        if path:
            _delete(t.sparkSession, path)


@contextmanager
def inside(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete the tables made in the block when it ends, but for those that it adds to the list."""
    before, kept = set(_made), list(keep)
    try:
        yield kept
    finally:
        stay = before | {_path_of.get(t) for t in kept}
        for path in [p for p in _made if p not in stay]:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete every table made so far; only when no result that reads them is needed any more."""
    for path in list(_made):
        _delete(spark, path)

"""Folders that driver and executors share, for what one step writes and another reads, and how long they stay."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Folders that are there, by the session that made them, and those of open scopes, the innermost last.
_THERE: dict[str, SparkSession] = {}
_SCOPES: list[set[str]] = []


def staging_folder(spark: SparkSession) -> str:
    """A fresh folder under the session's spark.checkpoint.dir, deleted with its scope, or when the driver ends.

    Where that is not set, a folder of our own serves a session on one machine (a local master); elsewhere
    it is an error, as executors could not see it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="clearfield-"))
        known = _OWN[0]
    folder = f"{known.rstrip('/')}/frames-{uuid.uuid4().hex}"
    if not _THERE:
        atexit.register(_remove_all)
    _THERE[folder] = spark
    if _SCOPES:
        _SCOPES[-1].add(folder)
    return folder


def _remove_all() -> None:
    for folder, spark in list(_THERE.items()):
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a staging folder that nothing reads any more."""
    _THERE.pop(folder, None)
    with contextlib.suppress(Exception):  # the session may have stopped already; the folder is then left to its owner
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df written to a staging folder and read back: its lineage is cut and its size known."""
    spark, folder = df.sparkSession, staging_folder(df.sparkSession)
    df.write.parquet(folder)
    back = spark.read.schema(df.schema).parquet(folder)
    back.staged_in = folder
    return back


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are deleted at the end, but for those of tables that are kept: results must be used up inside."""
    mine: set[str] = set()
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for folder in mine:
            remove(spark, folder)


def kept(df: DataFrame) -> DataFrame:
    """A written table that stays beyond the open scopes, until it is dropped."""
    for s in _SCOPES:
        s.discard(df.staged_in)
    return df


def drop(df: DataFrame) -> None:
    """Delete a written table."""
    remove(df.sparkSession, df.staged_in)

"""What operators need from the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: Whether Spark deletes the shuffle files of an execution when it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one is set only on a local master, where none is named. Raises on a cluster without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read as often as needed, and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/factloom-{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")  # nothing reads the shuffles of a write after it
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    _written.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``written(make(), label)``; the tables written on the way to it, which only ``make`` may know, are deleted."""
    first = len(_written)
    kept = written(make(), label)
    for path in _written[first:-1]:
        _delete(kept.sparkSession, path)
    del _written[first:-1]
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` or ``settled`` made and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written)
        _written.remove(table._written)


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_written(spark: SparkSession) -> int:
    """Delete the tables that ``written`` made in this process; results that still read them must be stored before. Returns their number."""
    done = 0
    while _written:
        done += _delete(spark, _written.pop())
    return done

"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back: each part is committed once, so a lost
executor costs its unfinished tasks and nothing that was already written. The folder is the one
the cluster names in ``spark.checkpoint.dir``; only a local session without that setting gets a
folder of its own. A table is removed when its operator is done with it, or at exit.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Bytes of a row group: what a task holds while it writes, and reads at once.
ROW_GROUP_BYTES = 16 << 20
_removed_at_exit: set[str] = set()
#: Written tables that are still there, oldest first, by folder.
_tables: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenloom-")
        spark.conf.set(_SETTING, base)
    folder = f"{base.rstrip('/')}/lumenloom-{spark.sparkContext.applicationId}"
    if folder not in _removed_at_exit:
        _removed_at_exit.add(folder)
        atexit.register(_remove_quietly, spark, folder)
    return folder


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder; what comes back reads that table and nothing else."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing will read again: what was made from them is itself written."""
    for t in tables:
        path = getattr(t, "_lumenloom_path", None)
        if path is not None and _tables.pop(path, None) is not None:
            remove(t.sparkSession, path)


def written() -> set[str]:
    """The tables that are there now; for ``drop_since``."""
    return set(_tables)


def drop_since(before: set[str], *kept: DataFrame) -> None:
    """Remove all tables written after ``before`` was taken but ``kept``."""
    keep = {getattr(t, "_lumenloom_path", None) for t in kept}
    for path in [p for p in _tables if p not in before and p not in keep]:
        remove(_tables.pop(path), path)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``, on any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session may be gone by now; its folder then stays
        pass

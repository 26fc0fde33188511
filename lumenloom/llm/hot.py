"""Joins in which one key may hold a third of all rows, and the memory of Python workers."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has at least LEAST rows and at least one in MOST of all: so there are at most MOST hot keys.
LEAST, MOST = 256, 10_000
#: Bytes of a batch that goes to a Python worker: bounds a task's memory whatever texts are in it.
BATCH_BYTES = 16 << 20


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``count`` how many of ``rows`` have the key (or more).

    Rows of hot keys stay in their tasks and meet those keys' rows of ``table`` there: of a total
    of n rows at most MOST keys can be hot, which bounds what is broadcast. All others are joined
    as Spark sees fit, so no task gets more than about LEAST rows or one in MOST for a key. Both
    sides should be written tables; they are read twice if a key is hot. ``how``: inner or left.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(LEAST, (total or 0) // MOST)
    if most is None or most < limit:
        return rows.join(table, keys, how)
    hot = table.where(F.col(count) >= limit)
    one = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(count) < limit), keys, how)
    return one.unionByName(rest)


def bounded(spark: SparkSession) -> None:
    """Have batches for Python workers bounded in bytes as well, unless the session says how."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give memory that a worker has freed back to the machine: workers wait for further tasks, and beside them others need it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass

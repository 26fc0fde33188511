"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.scratch import cut


def with_rank(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``, a row's place from 1 in the given order, nulls as the order says.

    Rows are sorted by ranges and numbered within each; a range's first place follows from the
    counts of the ranges before it, one row each. Rows alike in ``order`` come in any order. An
    empty table gives an empty one.
    """
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = cut(numbered, "ranked")
    part = F.shiftright("__id", 33)  # the number's upper bits are the range's, its lower ones the place in it
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    placed = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")  # as many rows as partitions
    return placed.withColumn(name, F.col("__before") + F.col("__id") - F.shiftleft("__part", 33) + 1).drop("__part", "__before", "__id")

"""Text files as records that end at a given text, read in splits, in file order; and files made of parts.

A file is read by as many tasks as it has splits: a record belongs to the split that it begins
in. Its place is the split's first byte and its number among the task's records; ``placed`` makes
one number of them. A gzipped file is one split: one task unpacks it, record by record, and deals the
records out, so that what is done with them is many tasks' work. A folder is one document
in parts, in the order of the parts' numbers. What a task holds is a record, whatever the file's size.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Any

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.scratch import remove, size_of

#: Where a record is: kept with it until the rows are written, then given to ``placed``.
WHERE = ["file", "block", "at"]


def _by_file() -> list[Column]:
    return [F.length("file"), F.col("file")]  # "part-100000" comes after "part-99999"


def read(spark: SparkSession, paths: list[str], end: str) -> DataFrame:
    """``provider, file, block, at, value``: the records of each path's files, ``provider`` its place in the list."""
    def one(k: int, path: str) -> DataFrame:
        where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
        text = spark.read.text(path, lineSep=end)
        rows = text.select(F.lit(k).alias("provider"), *where, "value")
        packed = any(f.endswith(".gz") for f in text.inputFiles())
        return rows.repartition("file", "at") if packed else rows

    return reduce(DataFrame.unionByName, [one(k, p) for k, p in enumerate(paths)])


def of_documents(documents: DataFrame, end: str, *keys: str) -> DataFrame:
    """The same of whole documents in ``value``, one a row."""
    pieces = F.posexplode(F.split(F.coalesce("value", F.lit("")), rf"\Q{end}\E", -1)).alias("n", "value")
    return documents.select(*keys, F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), pieces).select(*keys, "file", "block", F.col("n").cast("long").alias("at"), "value")


def splits(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """A row for each split of written ``rows``: ``first`` and ``last`` place in it, and the given aggregates."""
    return rows.groupBy(*keys, "file", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), *sums)


def in_file_order(*keys: str) -> Window:
    """Splits of a document, one after the other; a row a split."""
    return Window.partitionBy(*keys).orderBy(*_by_file(), "block")


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Written ``rows`` with ``seq`` instead of where they are: ascending with the document's records, 0 for its first; and ``tail``, whether a record is its file's last, which nothing ends.

    A split has fewer records than bytes, so its first byte and a record's number in it, added, ascend.
    """
    parts = splits(rows, keys)
    files = parts.groupBy(*keys, "file").agg(F.max(F.col("block") + F.col("last") - F.col("first") + 1).alias("width"), F.max("block").alias("end"))
    before = F.sum("width").over(Window.partitionBy(*keys).orderBy(*_by_file())) - F.col("width")  # a row a file
    files = files.select(*keys, "file", "end", before.alias("base"))
    where = parts.join(files, [*keys, "file"]).select(*keys, "file", "block", (F.col("base") + F.col("block") - F.col("first")).alias("_base"), F.when(F.col("block") == F.col("end"), F.col("last")).alias("_last"))
    # broadcast, as rows of a packed file, or of a long split, all have one key: a sorted join would have them in one task
    found = rows.join(F.broadcast(where), [*keys, "file", "block"])  # a row a split
    return found.withColumns({"seq": F.col("at") + F.col("_base"), "tail": F.coalesce(F.col("at") == F.col("_last"), F.lit(False))}).drop(*WHERE, "_base", "_last")


def write(blocks: DataFrame, order: list[str], path: str, gzip: bool, whole: bool = True) -> int:
    """Write ``value`` of ``blocks`` in order below ``path``; gives the bytes written.

    Blocks are sorted by ranges and each range is written, and packed, by a task of its own. The
    parts, put one after the other, are the file: packed parts as well, as a gzip file may have
    many members. ``whole`` puts them together. That moves bytes and does nothing else: a file
    system that can join files does so without moving any, else they are copied once, by a buffer.
    """
    spark = blocks.sparkSession
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}" if whole else path
    ranged = blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    ranged.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(parts)
    if whole:
        _join(spark, parts, path, "part-00000.txt" + (".gz" if gzip else ""))
        remove(spark, parts)
    return size_of(spark, path)


def _join(spark: SparkSession, parts: str, path: str, name: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    folder = Path(path)
    fs = folder.getFileSystem(conf)
    found = [s.getPath() for s in fs.listStatus(Path(parts))]
    files = sorted((p for p in found if p.getName().startswith("part-")), key=lambda p: (len(p.getName()), p.getName()))
    joined = files[0]
    if len(files) > 1 and not _concat(spark, fs, files):
        joined = Path(parts, "joined")
        stream = fs.create(joined, True)
        try:
            for p in files:
                part = fs.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, 1 << 20, False)
                finally:
                    part.close()
        finally:
            stream.close()
    fs.delete(folder, True)
    fs.mkdirs(folder)
    if not fs.rename(joined, Path(folder, name)):  # readers see the whole file or none
        raise OSError(f"{path}: the finished file could not be given its name")


def _concat(spark: SparkSession, fs: Any, files: list[Any]) -> bool:
    """Join files to the first one in the file system; false where it can't, which leaves all as they were."""
    rest = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(files) - 1)
    for k, p in enumerate(files[1:]):
        rest[k] = p
    try:
        fs.concat(files[0], rest)
    except UnsupportedOperationException:
        return False
    return True

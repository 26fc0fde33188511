"""Token ids in Parquet list columns, one row a document, in the order of document ids.

A file is a shard: a range of documents, so page and row group statistics of ``doc_id`` and ``at``
are narrow and a reader skips pages by them. ``ids`` is dictionary-coded, the numbers beside it,
which hardly repeat but grow slowly, are delta-coded, and pages hold few rows, with the page
indexes that a selective read needs. Row groups are small, which bounds the memory of a task that
writes or reads. Places are stored from the shard's begin; a small index has each shard's base.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.llm.bytewords import SLICE_BYTES, slices
from lumenloom.llm.hot import bounded, release
from lumenloom.scratch import new_path

TOKENIZER = "word_bpe_49k.json"
#: The id that ends each document.
END_ID = 2
ROWS = "shard int, at long, doc_id long, n_tokens long, ids array<int>"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 512
#: How the files are written; the second version of the format codes by deltas what has no dictionary.
LAYOUT = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.enable.dictionary#shard": "true",
}


def _encoded(tokenizer: str, end_id: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lumenloom.llm.word_ids import word_ids

        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch.column(1), slice_bytes):
                ids, sizes = word_ids(tokenizer).ids(part.data, part.at)
                upto = np.cumsum(sizes + 1)
                flow = np.full(int(upto[-1]), end_id, np.int32)
                inner = np.ones(len(flow), bool)
                inner[upto - 1] = False
                flow[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, upto).astype(np.int32)), pa.array(flow))
                own = batch.column(0).slice(part.first, len(part))
                columns = [pa.array(np.full(len(part), shard, np.int32)), pa.array(at + upto - sizes - 1), own, pa.array(sizes + 1), lists]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)
                at += int(upto[-1])
        release()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, slice_bytes: int = SLICE_BYTES) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, below ``path``: ``tokens`` and ``index``.

    Documents ascend by id over all files, null ids last; rows of one id come in the order of a
    hash of their texts, and rows alike in both are interchangeable. Null and empty texts are the
    end id alone. Texts are sorted by ranges and encoded where they end up. Special strings inside
    texts are what the tokenizer makes of them by default. ``files`` is the number of files; without
    it Spark makes them as large as its partitions. Other columns are left out; an empty
    table gives files without rows.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # equal rows, however many, are spread over ranges by the place where they were read
    order = [F.col("doc_id").asc_nulls_last(), "hash", "place"]
    placed = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(*[files] * (files is not None), *order).sortWithinPartitions(*order)
    placed.select("doc_id", "text").mapInArrow(_encoded(tokenizer, end_id, slice_bytes), ROWS).write.options(**LAYOUT).parquet(f"{path}/tokens")
    shards = _tokens(docs.sparkSession, path).groupBy("shard").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")  # a row a file
    shards.withColumn("base", before).coalesce(1).write.parquet(f"{path}/index")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/tokens")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``shard, first_doc, last_doc, documents, tokens, base``: a row a file that has documents."""
    return spark.read.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of documents ``first`` to ``last`` by id, or of all.

    ``start`` is the number of ids of all documents before it, in the whole data set. The bounds
    reach the scan, which skips files, row groups and pages by their statistics; without ``ids``
    only the numbers are read.
    """
    rows = _tokens(spark, path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    out = rows.join(F.broadcast(read_index(spark, path).select("shard", "base")), "shard")  # a row a file
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *["ids"] * ids)


def read_span(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """Ids ``start`` to ``start + length - 1`` of the whole data set, as ``doc_id, start, ids``: a row for each document that holds some, cut to them.

    The index gives the shards and the places in them, so only their pages are read.
    """
    stop = start + length
    found = read_index(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("tokens") > start)).select("shard", "base").collect()  # files that the span touches
    rows = _tokens(spark, path)
    hit = F.lit(False)
    for shard, base in found:
        hit = hit | ((F.col("shard") == shard) & (F.col("at") < stop - base) & (F.col("at") + F.col("n_tokens") > start - base))
    if found:  # plain comparisons for the scan
        rows = rows.where(F.col("shard").isin([s for s, _ in found]) & (F.col("at") < max(stop - base for _, base in found)))
    rows = rows.where(hit).join(F.broadcast(read_index(spark, path).select("shard", "base")), "shard").withColumn("begin", F.col("base") + F.col("at"))
    skip = F.greatest(F.lit(0), F.lit(start) - F.col("begin"))
    keep = F.least(F.col("n_tokens"), F.lit(stop) - F.col("begin")) - skip
    return rows.select("doc_id", (F.col("begin") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), keep.cast("int")).alias("ids"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        edges = lists.offsets.to_numpy()
        flow = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flow[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    release()


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(TOKENIZER))
    return read_documents(spark, path).mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")

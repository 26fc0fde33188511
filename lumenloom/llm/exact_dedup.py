"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. The rows' 64-bit fingerprints are written, eight bytes a row, and read by few large tasks, so
   that messages stay long on a large cluster. Each task sorts its distinct fingerprints and sends
   them, Rice-coded, to owners: an owner has all fingerprints with the same leading bits. A
   fingerprint goes out once a task, with its number if the task holds it again, so a group of
   copies that fills a third of the table costs an owner one entry a task.
2. An owner decodes what it was sent and answers each message with a bitmap of duplicates.
3. Rows with marked fingerprints are the suspects. Only suspects' texts are shuffled, and grouped
   on their bytes, partially within each task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm.hot import bounded, join_hot, release
from lumenloom.scratch import cut, drop

#: Fingerprints that an owner should get; owners are as many as that takes. And those that a task codes at once.
OWNER_ROWS, SENT_ROWS = 1 << 20, 4 << 20
#: Distinct duplicate fingerprints of eight bytes that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_PRINTS, SALTS = 2_000_000, 16

_P = "__lm_"


def rice_encode(values: np.ndarray) -> tuple[bytes, int]:
    """Sorted distinct unsigned 64-bit values: gaps in Golomb code with a power of two as divisor. Gives the bytes and the number of low bits."""
    if not len(values):
        return b"", 0
    gaps = np.diff(values, prepend=np.uint64(0))
    low = max(0, int(np.log2(max(1.0, float(values[-1]) / len(values)))))
    high = (gaps >> np.uint64(low)).astype(np.int64)
    # unary part: a one ends each run of zeros; binary part: the low bits, most significant first
    unary = np.zeros(int(high.sum()) + len(values), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    shifts = np.arange(low - 1, -1, -1, dtype=np.uint64)
    binary = ((gaps[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([binary, unary])).tobytes(), low


def rice_decode(blob: bytes, low: int, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    binary = bits[: n * low].reshape(n, low).astype(np.uint64)
    gaps = np.zeros(n, np.uint64)
    for k in range(low):
        gaps = (gaps << np.uint64(1)) | binary[:, k]
    ends = np.flatnonzero(bits[n * low :])[:n]
    high = np.diff(ends, prepend=-1) - 1
    return np.cumsum((high.astype(np.uint64) << np.uint64(low)) | gaps, dtype=np.uint64)


def _bits(owners: int) -> int:
    """Leading bits of a fingerprint that name its owner."""
    return (owners - 1).bit_length()


def _messages(bits: int):
    """Sends the fingerprints of a task, some millions at a time: each owner's, sorted, coded, and with a bit for what came more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += batch.num_rows
            if size >= SENT_ROWS:
                yield _coded(np.concatenate(held), bits)
                held, size = [], 0
        if size:
            yield _coded(np.concatenate(held), bits)
        release()

    return send


def _coded(prints: np.ndarray, bits: int) -> pa.RecordBatch:
    values, n = np.unique(prints, return_counts=True)
    owner = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    rows = []
    for a, b in zip(edges, np.append(edges[1:], len(values)), strict=True):
        k = int(owner[a])
        blob, low = rice_encode(values[a:b] - np.uint64(k << (64 - bits) if bits else 0))
        rows.append((k, int(b - a), low, blob, np.packbits(n[a:b] > 1).tobytes(), n[a:b][n[a:b] > 1].astype("<i4").tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MESSAGE.split(", ")])


MESSAGE = "owner int, n int, low int, prints binary, again binary, counts binary"
ANSWER = "owner int, n int, low int, prints binary, bitmap binary, totals binary"


def _answers(messages: pd.DataFrame) -> pd.DataFrame:
    """One owner's messages with their bitmaps: a bit is set if the fingerprint came again, in this message or in another; and for each set bit how many rows have it in all."""
    decoded = [rice_decode(b, low, n) for b, low, n in zip(messages["prints"], messages["low"], messages["n"], strict=True)]
    counts = []
    for again, some, n in zip(messages["again"], messages["counts"], messages["n"], strict=True):
        count = np.ones(n, np.int64)
        count[np.unpackbits(np.frombuffer(again, np.uint8))[:n].astype(bool)] = np.frombuffer(some, "<i4")
        counts.append(count)
    everything, where = np.unique(np.concatenate(decoded), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts), minlength=len(everything)).astype("<i8")
    own = np.split(total[where], np.cumsum([len(d) for d in decoded])[:-1])
    answers = [(np.packbits(t > 1).tobytes(), t[t > 1].tobytes()) for t in own]
    return messages[["owner", "n", "low", "prints"]].assign(bitmap=[b for b, _ in answers], totals=[t for _, t in answers])


def _marked(bits: int):

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                values = rice_decode(r.prints, r.low, r.n) + np.uint64(r.owner << (64 - bits) if bits else 0)
                again = np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: r.n].astype(bool)
                yield pd.DataFrame({"print": values[again].view(np.int64), "rows": np.frombuffer(r.totals, "<i8")})
        release()

    return decode


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def marked_prints(keys: DataFrame) -> DataFrame:
    """``print, rows`` of all fingerprints that more than one row of ``keys(print)``, a written table, has; a written table itself."""
    rows = keys.count()
    bits = _bits(max(1, -(-rows // OWNER_ROWS), min(64, rows // 4096)))
    messages = keys.select("print").mapInArrow(_messages(bits), MESSAGE)
    answers = messages.groupBy("owner").applyInPandas(_answers, ANSWER)
    return cut(answers.mapInPandas(_marked(bits), "print long, rows long").distinct(), "marked")


def with_print(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the digest of the normalised text and its first 64 bits."""
    out = docs.withColumn(_P + "sha256", F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    return out.withColumn(_P + "print", F.conv(F.substring(_P + "sha256", 1, 16), 16, -10).cast("long"))


def _suspects(rows: DataFrame, marked: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose fingerprint is marked (``keep`` False: the others).

    Marked fingerprints go to every executor if they are few enough; else each is dealt SALTS
    times and so are the rows, so the copies of one text aren't all sent to one task.
    """
    how = "left_semi" if keep else "left_anti"
    prints = marked.select(F.col("print").alias(_P + "print"))
    if prints.count() <= BROADCAST_PRINTS:
        return rows.join(F.broadcast(prints), _P + "print", how)
    salted = prints.withColumn(_P + "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn(_P + "salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return own.join(salted, [_P + "print", _P + "salt"], how).drop(_P + "salt")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without blanks; null counts as empty. Of a group the
    row with the longest original text stays, then the smallest id (null last); of rows alike in
    both, the first as read, so one row of each group stays. Other columns are left out; an empty
    table gives an empty one.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    keys = with_print(rows, "text").select("doc_id", (-F.length("text")).alias("less"), F.col(_P + "sha256").alias("sha"), F.col(_P + "print").alias("print"))
    # a small row for each row: where it was read, what it is, its fingerprint
    keys = cut(keys.withColumn("row", F.monotonically_increasing_id()), "prints")
    marked = marked_prints(keys)
    # suspects' texts, compared byte by byte: equal ones meet in one group, within each task first
    texts = _suspects(with_print(rows, "text"), marked)
    verified = texts.groupBy(normalised(F.col("text")).alias("norm")).agg(F.first(_P + "sha256").alias("sha")).groupBy("sha").agg(F.count("*").alias("texts"))
    suspect = _suspects(keys.withColumnRenamed("print", _P + "print"), marked)
    first = F.min(F.struct("less", F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = suspect.groupBy("sha").agg(first.alias("best"), F.count("*").alias("n")).join(verified, "sha")
    one = F.when(F.col("texts") == 1, F.col("best")).otherwise(F.raise_error(F.lit("one digest, two texts")).cast("struct<less:int,none:boolean,doc_id:bigint,row:bigint>"))
    groups = cut(groups.select("sha", one.alias("best"), "n"), "groups")
    drop(marked)
    out = join_hot(keys, groups, ["sha"], "n", "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those whose fingerprint is theirs alone, and of each group of suspects with equal bytes the one that ``exact_groups`` keeps.

    Null texts count as empty, and empty texts are one group. Null ids come after all others; of
    rows alike in length and id one stays, chosen by a hash of all columns. Columns may have any
    names; an empty table gives an empty one.
    """
    bounded(docs.sparkSession)
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    ident, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    keyed = with_print(own, text)
    marked = marked_prints(cut(keyed.select(F.col(_P + "print").alias("print")), "prints"))
    alone = _suspects(keyed, marked, keep=False).select(*names)
    size, key = F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.col(ident).cast("long")
    order = F.struct(-size, key.isNull(), key, F.xxhash64(*names))
    best = _suspects(keyed, marked).groupBy(normalised(F.col(text)).alias("norm")).agg(F.min_by(F.struct(*names), order).alias("best"))
    return alone.unionByName(best.select("best.*")).toDF(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS rn, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY rn) AS keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""

"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm.bytewords import SLICE_BYTES, slices, sums
from lumenloom.llm.hot import bounded, release

#: Texts with more tokens than this are marked.
LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Bytes and tokens of every whole text, without begin, end or added special tokens.

    ``tokenizer``: the file of a tokenizer, at the same place on every executor. Rows are worked
    on in slices of about ``slice_bytes`` of text, however many rows that is, and texts are split
    at boundaries that no token crosses (see ``units``), so a very long text needs no call of its
    own length. Null and empty texts have no byte and no token. A null id stays null, repeated
    rows give repeated rows, other columns are left out, an empty table gives an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenloom.llm.units import counter, cuts

        for batch in batches:
            n_bytes, n_tokens = [], []
            for part in slices(batch.column(1), slice_bytes):
                starts, first = cuts(part.data, part.at)
                n_bytes.append(np.diff(part.at))
                n_tokens.append(sums(counter(tokenizer).counts(part.data, starts), first))
            if not n_bytes:
                continue
            tokens = np.concatenate(n_tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_bytes)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    bounded(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))

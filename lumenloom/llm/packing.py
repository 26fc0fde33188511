"""Sum-of-squares online packing of token sequences into windows of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm.bytewords import SLICE_BYTES, slices, sums
from lumenloom.llm.hot import bounded, release

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Levels:
    """Open windows by fill level; ``count[h]`` is how many hold h tokens.

    An item of r tokens goes to the level h (0: a new window) for which the sum of squared counts
    becomes least, the fullest on a tie. That sum changes by 2(N[h+r] - N[h]) + 2, by 2N[r] + 1
    for a new window and by 1 - 2N[h] where the window becomes full.
    """

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window + 1)]

    def choose(self, r: int, new: bool = True) -> int:
        """The level for r tokens; ``new`` False: of the open windows' only, 0 if they have no room."""
        n, w = self.count, self.window
        cost = 2 * (n[r:] - n[: w - r + 1]) + 2
        cost[-1] = 1 - 2 * n[w - r]
        cost[n[: w - r + 1] == 0] = np.iinfo(np.int64).max
        if new:
            cost[0] = 2 * n[r] + 1 if r < w else 1
        elif cost.min() == np.iinfo(np.int64).max:
            return 0
        return w - r - int(np.argmin(cost[::-1]))

    def most(self) -> int:
        """The level with the most windows, the fullest on a tie: filling one of them lowers the sum of squares most. 0 without open windows."""
        k = int(np.argmax(self.count[:0:-1]))
        return self.window - k if self.count[self.window - k] else 0

    def least(self) -> int:
        """The emptiest level that has windows."""
        filled = np.flatnonzero(self.count)
        return int(filled[0]) if len(filled) else 0

    def take(self, h: int):
        if h == 0:
            return None
        self.count[h] -= 1
        return self.open[h].pop()

    def put(self, h: int, window) -> None:
        self.count[h] += 1
        self.open[h].append(window)


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """One task's windows. ``add`` and ``finish`` leave finished rows in ``rows``."""

    def __init__(self, base: int, window: int):
        self.levels, self.window, self.next, self.rows = Levels(window), window, base, []

    def _emit(self, pieces: list) -> None:
        sequence, offset = self.next, 0
        self.next += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset))
            offset += len(ids)

    def add(self, doc, ids: np.ndarray) -> None:
        """``ids``: a document's, little-endian unsigned 32-bit. Whole windows of a long document are cut off first; the rest is placed by the levels."""
        total, w = len(ids), self.window
        whole = total // w * w
        for start in range(0, whole, w):
            self._emit([(doc, start, ids[start : start + w], total)])
        r = total - whole
        if r:
            h = self.levels.choose(r)
            # the slice's ids go when the slice is done; an open window keeps its own
            self._place(h, (doc, whole, ids[whole:] if h + r == w else ids[whole:].copy(), total))

    def _place(self, h: int, piece: tuple) -> None:
        pieces = self.levels.take(h) or []
        pieces.append(piece)
        if h + len(piece[2]) == self.window:
            self._emit(pieces)
        else:
            self.levels.put(h + len(piece[2]), pieces)

    def finish(self) -> None:
        """Windows that are still open leave no padding: the emptiest is dissolved and its pieces are placed by the same rule among the others, again and again.

        A piece that fits into no window fills one of the commonest level and goes on with its
        rest. What the last window holds is cut into powers of two, which need no padding.
        """
        levels = self.levels
        while levels.count.sum() > 1:
            for doc, start, ids, total in sorted(levels.take(levels.least()), key=lambda p: -len(p[2])):
                while len(ids):
                    h = levels.choose(len(ids), new=False)
                    room = len(ids) if h else self.window - levels.most()
                    self._place(h or levels.most(), (doc, start, ids[:room], total))
                    start, ids = start + room, ids[room:]
        left = [p for windows in levels.open for pieces in windows for p in pieces][::-1]
        self.levels = Levels(self.window)
        for size in _powers(sum(len(p[2]) for p in left)):
            pieces, room = [], size
            while room:
                doc, start, ids, total = left.pop()
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:], total))
                room -= len(pieces[-1][2])
            self._emit(pieces)


def pack_sequences(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of every whole document in sequences of at most ``window`` tokens.

    Packing is online and needs no exchange: each task places its documents in turn, holding the
    level array and the pieces of its open windows only (a few for each level at most, since
    filling a window lowers the sum of squares); what is open at its end is placed again by the
    same rule, emptiest window first. Sequence ids carry the task's number, so they don't clash.
    Null and empty texts are the end id alone. Null ids stay null; repeated rows are packed as
    often as they occur; other columns are left out; an empty table gives no sequence.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lumenloom.llm.units import cuts, encoder

        packer = Packer(TaskContext.get().partitionId() << 36, window)

        def table() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], _NAMES)

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for part in slices(batch.column(1), slice_bytes):
                starts, first = cuts(part.data, part.at)
                ids, sizes = encoder(tokenizer, ranks, pattern).ids(part.data, starts)
                length = sums(sizes, first) + 1
                upto = np.cumsum(length)
                flow = np.full(int(upto[-1]), end_id, "<u4")
                inner = np.ones(len(flow), bool)
                inner[upto - 1] = False
                flow[inner] = ids
                for k in range(len(part)):
                    packer.add(ids_of[part.first + k], flow[upto[k] - length[k] : upto[k]])
                if packer.rows:
                    yield table()
        packer.finish()
        if packer.rows:
            yield table()
        release()

    bounded(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(pack, SCHEMA)


def pack_with_public_tokenizer(docs: DataFrame) -> DataFrame:
    """``pack_sequences`` with the byte-level vocabulary of 50,000 tokens and its rank file."""
    import public_tokenizers

    return pack_sequences(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public_tokenizer(spark.read.parquet(f"{sf_dir}/documents.parquet"))

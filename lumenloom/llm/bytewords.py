"""Words of whole Arrow text columns, found and hashed on their UTF-8 bytes with numpy.

Every word pattern of this subpackage treats all bytes from 0x80 alike, so looking at bytes gives
the same words as looking at code points. Nothing here makes a Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_LONG_WORD = 512


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = _table(set(range(256)) - set(_BLANKS))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, for text whose A-Z are in lower case
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


@dataclass
class Texts:
    """Some rows' texts as one byte array: row ``first + k`` is ``data[at[k]:at[k + 1]]``."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, k: int) -> str:
        return self.data[self.at[k] : self.at[k + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        end = min(end, n)
        yield Texts(k, raw[at[k] : at[end]], at[k : end + 1] - at[k])
        k = end


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _FOLD[data]


def words(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and each text's first word: text k has words ``first[k]`` to ``first[k + 1] - 1``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = member[data]
    inner = at[(at > 0) & (at < len(data))]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[inner] |= inside[inner]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[inner - 1] |= inside[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S1, _S2 = np.uint64(29), np.uint64(32)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (a multiply-and-shift finaliser)."""
    h = (h ^ np.uint64(seed & (2**64 - 1))) * _C1
    h ^= h >> _S2
    h *= _C2
    h ^= h >> _S1
    return h


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[starts[i]:ends[i]]``: eight bytes of all spans at a time."""
    n = len(starts)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    out += size.astype(np.uint64) * _C2
    live = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    done = 0
    while len(live):
        left = np.minimum(size[live] - done, 8)
        out[live] = mix(out[live] ^ (eight[starts[live] + done] & _KEEP[left]), done + 1)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def hash_of(word: bytes) -> int:
    """``spans_hash`` of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(spans_hash(data, np.array([0]), np.array([len(word)]))[0])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices ``starts[0] .. starts[0] + sizes[0] - 1, starts[1] ..`` in one array."""
    total = int(sizes.sum())
    out = np.ones(total, np.int64)
    keep = sizes > 0
    s, n = starts[keep], sizes[keep]
    if not len(s):
        return out[:0]
    out[0] = s[0]
    begin = np.cumsum(n)[:-1]
    out[begin] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each run ``values[first[k]:first[k + 1]]`` the sum; runs may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]

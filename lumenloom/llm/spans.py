"""Distinct spans of a byte array, told apart by their bytes, and what a worker knows of spans seen before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lumenloom.llm.bytewords import ragged, spans_hash

#: Distinct spans that a worker keeps; with more it starts anew.
KEPT_SPANS = 400_000


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether ``data[a[i]:a[i] + size[i]]`` and ``data[b[i]:b[i] + size[i]]`` are equal for every i."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, done = np.flatnonzero((a != b) & (size > 0)), 0
    while len(live):
        drop = (8 * (8 - np.minimum(size[live] - done, 8))).astype(np.uint64)
        if np.any((eight[a[live] + done] ^ eight[b[live] + done]) << drop):
            return False
        done += 8
        live = live[size[live] > done]
    return True


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans, and for each span the place of its like. Hashes group them; that groups hold equal bytes is checked."""
    raw = data.tobytes()
    if not len(starts):
        return [], np.zeros(0, np.int64)
    _, one, where = np.unique(spans_hash(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    if np.array_equal(size, size[one][where]) and _alike(data, starts, starts[one][where], size):
        return [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], where
    places: dict[bytes, int] = {}
    where = np.array([places.setdefault(raw[a:b], len(places)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return list(places), where


class Known:
    """Numbers for spans. ``add`` is called with spans that are new, in the order of their numbers, and ``reset`` when numbers start anew."""

    def __init__(self, add: Callable[[list[bytes]], None], reset: Callable[[], None], keep: int = KEPT_SPANS):
        self.add, self.reset, self.keep, self.number = add, reset, keep, {}

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.number) > self.keep:
            self.number = {}
            self.reset()
        spans, where = distinct_spans(data, starts, ends)
        new = [s for s in spans if s not in self.number]
        if new:
            self.add(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        return np.array([self.number[s] for s in spans], np.int64)[where] if spans else where


class Rows:
    """Rows of numbers of unlike lengths, one after the other."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.values, self.used, self.begin, self.size = np.zeros(1 << 12, self.kind), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """More rows: their values one after the other, and the number of each."""
        if self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(self.used + len(values), self.kind)])
        self.values[self.used : self.used + len(values)] = values
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(values)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows one after the other, and the number of each."""
        size = self.size[numbers]
        return self.values[ragged(self.begin[numbers], size)], size

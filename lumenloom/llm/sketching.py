"""Shingle sets of whole texts and their fast similarity sketches, with numpy on Arrow batches.

The sketch of a set has t coordinates and is filled in rounds (Dahlgaard, Knudsen and Thorup,
"Fast similarity sketching"). In each of the first t rounds every shingle falls into one
coordinate chosen by a hash; in the next t rounds all shingles fall into coordinate 0, 1, .. in
turn, which guarantees that every coordinate fills. A coordinate keeps its first round's least
value, and a set stops at the round after which nothing is empty: one round for a set of several
times t ln t shingles. Equal coordinates of two sets estimate their Jaccard similarity as sharply
as independent ones would.
"""

from __future__ import annotations

import numpy as np

from lumenloom.llm.bytewords import NOT_BLANK, Texts, fold, mix, ragged, spans_hash, words

_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(part: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words, in one array, and where each text's begin.

    A text of fewer words has its whole sequence as one shingle, and one without words none.
    """
    data = fold(part.data)
    starts, ends, first = words(data, part.at, NOT_BLANK)
    own = spans_hash(data, starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = ragged(first[:-1], n)
    out = np.zeros(len(at), np.uint64)
    short = np.repeat((n_words < size) & (n_words > 0), n)
    upto = np.repeat(first[1:], n)
    for k in range(size):
        inside = at + k < upto
        out[inside] = mix(out[inside] ^ own[at[inside] + k], k + 1)
    out[short] = mix(out[short] ^ (upto - at)[short].astype(np.uint64), 99)
    begin = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[begin[:-1][n > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[begin]


def set_digest(values: np.ndarray, begin: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit value of each set, the same for the same set."""
    out = np.zeros(len(begin) - 1, np.uint64)
    some = begin[1:] > begin[:-1]
    if some.any():
        out[some] = np.add.reduceat(mix(values, seed), begin[:-1][some])
    return out


def sketches(values: np.ndarray, begin: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set; rows of empty sets hold nothing."""
    n_sets = len(begin) - 1
    out = np.full((n_sets, t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    active = np.flatnonzero(np.diff(begin) > 0)
    for i in range(2 * t):
        if not len(active):
            break
        sizes = begin[active + 1] - begin[active]
        v = mix(values[ragged(begin[active], sizes)], 7919 * (i + 1))
        where = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, np.repeat(active * t, sizes) + where, np.uint64(i << 32) | (v & np.uint64(0xFFFFFFFF)))
        active = active[(out[active] == _EMPTY).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for k in range(rows):
        out = mix(out ^ parts[:, :, k], k + 17)
    return out

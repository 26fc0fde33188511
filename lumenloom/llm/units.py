"""Token ids of whole texts from the ids of their distinct pieces.

A text is cut before each run of ASCII white space that follows another character. No pre-token
of the byte-level pattern, and no match of the word pattern, holds a white-space character after
another kind of character, and no special string holds white space, so encoding the pieces one
by one gives exactly the ids of the whole text. Most pieces occur again and again: the distinct
ones of a slice are encoded, and a bounded table keeps those seen first. Pieces are told apart by
length and a 64-bit hash.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from lumenloom.llm.bytewords import ragged, spans_hash

#: Distinct pieces that a worker keeps; later ones are encoded anew in each slice.
KEPT_UNITS = 200_000
#: Pieces that the library encodes in one call.
CALL_UNITS = 8_192

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def load(path: str):
    """The tokenizer in ``path``, on one thread: Spark's tasks are the parallelism here."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def _after_wide_blank(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space outside ASCII (C2 xx, E1..E3 xx xx)."""
    two = data[np.maximum(where - 2, 0)] == 0xC2
    three = data[np.maximum(where - 3, 0)]
    return (data[where - 1] >= 0x80) & (two | ((three >= 0xE1) & (three <= 0xE3)))


def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and each text's first piece: text k has pieces ``first[k]`` to ``first[k + 1] - 1``."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n:
        begin[1:n] = _BLANK[data[1:]] & (data[:-1] > 0x20)
        where = np.flatnonzero(begin)
        begin[where[_after_wide_blank(data, where)]] = False
    begin[at[:-1]] = True
    begin[n] = False
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, at)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the distinct pieces, and for each piece the place of its like."""
    ends = np.append(starts[1:], len(data)).astype(np.int64) if len(starts) else starts
    keys, one, where = np.unique(spans_hash(data, starts, ends), return_index=True, return_inverse=True)
    return keys, starts[one], ends[one], where


class Counter:
    """Numbers of tokens of pieces."""

    def __init__(self, path: str, keep: int = KEPT_UNITS):
        self.tokenizer, self.keep, self.known = load(path), keep, {}

    def _encode(self, pieces: list[str]) -> list[int]:
        out = []
        for k in range(0, len(pieces), CALL_UNITS):
            out += [len(x) for x in self.tokenizer.encode_batch_fast(pieces[k : k + CALL_UNITS], add_special_tokens=False)]
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        keys, s, e, where = distinct(data, starts)
        keys = keys.tolist()
        got = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(got < 0)
        if len(new):
            raw = data.tobytes()
            fresh = self._encode([raw[s[i] : e[i]].decode("utf-8", "replace") for i in new])
            got[new] = fresh
            room = max(0, self.keep - len(self.known))
            self.known.update((keys[i], n) for i, n in zip(new[:room].tolist(), fresh, strict=False))
        return got[where] if len(where) else np.zeros(0, np.int64)


class Encoder:
    """Token ids of pieces, by the tokenizer in ``path``.

    ``ranks``: a file that holds the same vocabulary as ranks. With it, pieces of Latin letters,
    digits and ASCII marks are encoded in one call of the faster library, to the same ids; pieces
    with special strings or with other code points always go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, keep: int = KEPT_UNITS):
        self.tokenizer, self.keep, self.known, self.fast = load(path), keep, {}, None
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = [], []
        specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = specials
        if ranks and all(s[:1] == b"<" for s in specials):
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
            for word, rank in table.items():
                self.bytes_of[rank] = len(word)

    def _plain(self, raw: bytes, s: np.ndarray, e: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Pieces that may be joined and encoded by ranks: they start with a blank, end otherwise, and hold code points below U+0250 only, no other white space and no special string."""
        if self.fast is None or not len(s):
            return np.zeros(len(s), bool)
        odd = np.cumsum(np.append(0, (data >= 0xCA) | (data == 0xC2) | ((data < 0x20) & ~_BLANK[data])), dtype=np.int64)
        ok = _BLANK[data[s]] & ~_BLANK[data[e - 1]] & (odd[e] == odd[s])
        mark = np.cumsum(np.append(0, data == ord("<")), dtype=np.int64)
        for i in np.flatnonzero(ok & (mark[e] > mark[s])):
            ok[i] = not any(x in raw[s[i] : e[i]] for x in self.specials)
        return ok

    def _encode(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the number of each."""
        raw = data.tobytes()
        plain = self._plain(raw, s, e, data)
        sizes = np.zeros(len(s), np.int64)
        joined = np.flatnonzero(plain)
        fast = np.zeros(0, np.uint32)
        if len(joined):
            text = b"".join([raw[s[i] : e[i]] for i in joined.tolist()]).decode()
            fast = np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            ends = np.cumsum(self.bytes_of[fast])
            want = np.cumsum(e[joined] - s[joined])
            upto = np.searchsorted(ends, want)
            if not np.array_equal(ends[upto], want):
                raise ValueError("a token reaches over a piece's end")
            sizes[joined] = np.diff(np.append(-1, upto))
        other = np.flatnonzero(~plain)
        slow: list[int] = []
        for k in range(0, len(other), CALL_UNITS):
            some = other[k : k + CALL_UNITS].tolist()
            for i, x in zip(some, self.tokenizer.encode_batch_fast([raw[s[i] : e[i]].decode("utf-8", "replace") for i in some], add_special_tokens=False), strict=True):
                slow += x.ids
                sizes[i] = len(x)
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        out[ragged(begin[joined], sizes[joined])] = fast
        out[ragged(begin[other], sizes[other])] = np.array(slow, np.uint32)
        return out, sizes

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the number of each."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, s, e, where = distinct(data, starts)
        keys = keys.tolist()
        place = np.array([self.known.get(k, -1) for k in keys], np.int64)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        if len(old):
            begin[old], size[old] = place[old] >> 20, place[old] & 0xFFFFF
        if len(new):
            order = new[np.argsort(s[new])]
            fresh, sizes = self._encode(data, s[order], e[order])
            if self.used + len(fresh) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(fresh) + self.used // 2, np.uint32)])
            self.pool[self.used : self.used + len(fresh)] = fresh
            begin[order], size[order] = self.used + np.cumsum(sizes) - sizes, sizes
            if len(self.known) + len(order) <= self.keep and int(sizes.max(initial=0)) <= 0xFFFFF:
                self.known.update(zip([keys[i] for i in order.tolist()], (begin[order] << 20 | size[order]).tolist(), strict=True))
                self.used += len(fresh)
        return self.pool[ragged(begin[where], size[where])], size[where]


@functools.cache
def counter(path: str) -> Counter:
    """This worker's; its table serves all tasks that the worker gets."""
    return Counter(path)


@functools.cache
def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks, pattern)

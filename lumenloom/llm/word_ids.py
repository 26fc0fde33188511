"""Token ids of the word vocabulary from its pattern's own units.

The pattern of that vocabulary matches runs of letters, single digits, runs of marks and the
English endings after an apostrophe; white space is in no match. So a match ends wherever an ASCII
letter, digit or mark is followed by ASCII of another kind, after each digit, and at white space;
an apostrophe before a letter is left with it. Nothing is cut next to a byte beyond ASCII, since
what is composed with it is known to the tokenizer only, or inside a special string. The units
between such places have the ids that they have in the whole text, and there are few distinct
ones. New ones that are a single match are encoded many at a time, as one text.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from lumenloom.llm.bytewords import ragged
from lumenloom.llm.spans import Known, Rows
from lumenloom.llm.units import CALL_UNITS, load

_BLANK, _LETTER, _DIGIT, _MARK, _WIDE = range(5)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x80:] = _WIDE
_APOSTROPHE = 0x27
#: What is one match of the pattern whatever stands around it: a run of Latin letters that stay letters in lower case, a digit.
_ONE_MATCH = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|\xC4[\x80-\xAF\xB1-\xBF]|[\xC5-\xC8][\x80-\xBF])+|[0-9]")
#: How many such units are encoded as one text, parted by blanks. The last token of each match is marked in the vocabulary.
_JOINED, _WORD_END = 512, "</w>"


def unit_spans(data: np.ndarray, at: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and each text's first: text k has units ``first[k]`` to ``first[k + 1] - 1``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    before, after = kind[:-1], kind[1:]
    edge = np.ones(len(data) + 1, bool)
    narrow = (before != _WIDE) & (after != _WIDE)
    edge[1:-1] = narrow & ((before != after) | (after == _DIGIT)) & ~((data[:-1] == _APOSTROPHE) & (after == _LETTER))
    # a blank is in no match, whatever stands beside it
    edge[1:-1] |= (before == _BLANK) != (after == _BLANK)
    raw = data.tobytes() if specials and (data == specials[0][0]).any() else b""
    for s in specials:
        for m in re.finditer(re.escape(s), raw):
            edge[m.start() + 1 : m.end()] = False
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    word = kind[starts] != _BLANK
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(starts, at)


class WordIds:
    """Token ids of texts, by the tokenizer in ``path``; special strings inside texts as that tokenizer does by default."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(_WORD_END)]] = True
        self.rows = Rows(np.uint32)
        self.known = Known(self._add, self.rows.clear)

    def _add(self, units: list[bytes]) -> None:
        plain = np.array([_ONE_MATCH.fullmatch(u) is not None for u in units])
        joined, other = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        sizes = np.zeros(len(units), np.int64)
        texts = [b" ".join([units[i] for i in joined[k : k + _JOINED]]).decode() for k in range(0, len(joined), _JOINED)]
        fast = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        fast = np.concatenate([np.zeros(0, np.uint32), *fast])
        sizes[joined] = np.diff(np.flatnonzero(self.ends[fast]), prepend=-1)
        slow: list[int] = []
        for k in range(0, len(other), CALL_UNITS):
            some = other[k : k + CALL_UNITS]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([units[i].decode("utf-8", "replace") for i in some], add_special_tokens=False), strict=True):
                slow += x.ids
                sizes[i] = len(x)
        begin, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.uint32)
        out[ragged(begin[joined], sizes[joined])] = fast
        out[ragged(begin[other], sizes[other])] = np.array(slow, np.uint32)
        self.rows.extend(out, sizes)

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's."""
        starts, ends, first = unit_spans(data, at, self.specials)
        ids, sizes = self.rows.take(self.known.numbers(data, starts, ends))
        return ids, np.diff(np.append(0, np.cumsum(sizes))[first])


@functools.cache
def word_ids(path: str) -> WordIds:
    """This worker's; what it knows serves all tasks that the worker gets."""
    return WordIds(path)

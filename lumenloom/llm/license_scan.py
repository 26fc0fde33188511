"""License scans: base phrases, and an exact set-similarity join of text blocks with templates.

A block is a line of a text, however long, or any run of the text's words, wherever its lines
break, up to twice as long as the template: so a wrapped notice may have words of its own in it.
A template is the wording of a notice, and a block matches it when it holds at least a given
share of the template's distinct words. Words of both are ordered by how often they occur in the
whole corpus, rarest first. A block that holds enough of a
template must hold a word of the template's prefix (prefix filter), have at least as many words
as must be common (length filter), and, from the place of its first common word on, the template
must still have that many words left (positional filter); what passes is verified on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm.hot import bounded, release
from lumenloom.llm.bytewords import ALNUM, SLICE_BYTES, Texts, fold, hash_of, slices, spans_hash, words

#: Phrases and the labels that they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of short notices, by label. A parameter of the scan; longer license texts can be given as well.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "Copyright. All rights reserved."),
]
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Words of a block over several lines, at most, as a multiple of the template's.
STRETCH = 2

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _words(text: str) -> list[bytes]:
    data = fold(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


class _Slice:
    """Words of a slice, and for each the number of the vocabulary word that it is, or -1. Equal hashes are compared byte by byte."""

    def __init__(self, part: Texts, vocabulary: list[bytes]):
        self.data = fold(part.data)
        self.starts, self.ends, self.first = words(self.data, part.at, ALNUM)
        if not vocabulary:
            self.word = np.full(len(self.starts), -1)
            return
        hashes = spans_hash(self.data, self.starts, self.ends)
        known = np.array([hash_of(w) for w in vocabulary], np.uint64)
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
        self.word = np.where(known[order][at] == hashes, order[at], -1)
        size = np.array([len(w) for w in vocabulary])
        self.word[(self.ends - self.starts) != size[self.word]] = -1
        raw = self.data.tobytes()
        for i in np.flatnonzero((self.word >= 0) & (size[self.word] > 8)).tolist():  # shorter words of one length have different hashes
            if raw[self.starts[i] : self.ends[i]] != vocabulary[self.word[i]]:
                self.word[i] = -1

    def lines(self, wanted: np.ndarray) -> np.ndarray:
        """For each wanted word the number of its line; a line never reaches over two texts."""
        newline = np.flatnonzero(self.data == 0x0A)
        begins = self.starts[wanted]
        text = np.searchsorted(self.first, wanted, "right")
        return np.searchsorted(newline, begins) + text


def _frequencies(vocabulary: list[bytes], slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch.column(0), slice_bytes):
                found = _Slice(part, vocabulary).word
                total += np.bincount(found[found >= 0], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["word", "n"])

    return run


class Join:
    """Templates ready for the join: their words by rank, the overlap each needs, and its prefix."""

    def __init__(self, templates: list[tuple[str, list[int]]], counts: list[int], threshold: float):
        order = sorted({w for _, t in templates for w in t}, key=lambda w: (counts[w], w))
        self.rank = {w: r for r, w in enumerate(order)}
        self.label = [label for label, _ in templates]
        self.wording = [t for _, t in templates]
        self.ranked = [sorted({self.rank[w] for w in t}) for _, t in templates]
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in self.ranked]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (t, need) in enumerate(zip(self.ranked, self.need, strict=True)):
            for place, r in enumerate(t[: len(t) - need + 1]):
                self.prefix.setdefault(r, []).append((k, place))

    def matches(self, block: set[int], size: int) -> dict[int, float]:
        """Templates that a block holds, with their containment. ``block``: its distinct words that any template has, ``size`` of them."""
        mine = sorted(self.rank[w] for w in block if w in self.rank)
        seen: set[int] = set()
        out: dict[int, float] = {}
        for at, r in enumerate(mine):
            for k, place in self.prefix.get(r, ()):
                if k in seen or size < self.need[k]:
                    continue
                seen.add(k)
                # the first common word that is met is the rarest: what is common stands from here on in both
                if min(len(self.ranked[k]) - place, len(mine) - at) < self.need[k]:
                    continue
                common = len(set(self.ranked[k]).intersection(mine))
                if common >= self.need[k]:
                    out[k] = common / len(self.ranked[k])
        return out


def _windows(join: Join, k: int, word: np.ndarray, at: np.ndarray, line: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, float]]:
    """Blocks over several lines, up to STRETCH times as long as template ``k``, that hold it: their first word's place in ``word``, and the containment.

    ``word``: the words of a slice that any template has; ``at``: their places in it; ``line``: their lines; ``end``: where
    their texts end. What a block holds is also held by the longest one that begins at its first common word, so only those are looked at.
    """
    member = np.zeros(len(word) and word.max() + 1, bool)
    rare = member.copy()
    for w, r in join.rank.items():
        if w < len(member):
            member[w] = r in join.ranked[k]
            rare[w] = any(t == k for t, _ in join.prefix.get(r, ()))
    mine = np.flatnonzero(member[word])
    word, at, line, end = word[mine], at[mine], line[mine], end[mine]
    upto = np.searchsorted(at, np.minimum(at + STRETCH * len(join.wording[k]), end))
    begin = np.arange(len(word))
    prefixes = np.concatenate([[0], np.cumsum(rare[word])])
    for i in np.flatnonzero((upto - begin >= join.need[k]) & (prefixes[upto] > prefixes[begin])).tolist():
        if line[i] == line[upto[i] - 1]:  # the line's own block has these words
            continue
        block = set(word[i : upto[i]].tolist())
        found = join.matches(block, len(block))
        if k in found:
            yield int(mine[i]), found[k]


def _scan(vocabulary: list[bytes], phrases: list[tuple[list[int], str]], join: Join, slice_bytes: int):
    in_prefix = np.zeros(len(vocabulary) + 1, bool)
    for w, r in join.rank.items():
        in_prefix[w] = r in join.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), slice_bytes):
                s = _Slice(part, vocabulary)
                n_docs = len(part)
                text_of = lambda at: np.searchsorted(s.first, at, "right") - 1
                count, low, high = np.zeros(n_docs, np.int64), np.full(n_docs, np.iinfo(np.int64).max), np.full(n_docs, -1)
                base: list[set[str]] = [set() for _ in range(n_docs)]
                for phrase, label in phrases:
                    m = len(phrase)
                    hit = np.ones(max(0, len(s.word) - m + 1), bool)
                    for k, w in enumerate(phrase):
                        hit &= s.word[k : k + len(hit)] == w
                    at = np.flatnonzero(hit)
                    doc = text_of(at)
                    inside = at + m <= s.first[doc + 1] if len(at) else np.zeros(0, bool)
                    at, doc = at[inside], doc[inside]
                    place = at - s.first[doc]
                    np.add.at(count, doc, 1)
                    np.minimum.at(low, doc, place)
                    np.maximum.at(high, doc, place)
                    for d in np.unique(doc).tolist():
                        base[d].add(label)
                labels, score = [set(x) for x in base], [1.0 if x else 0.0 for x in base]
                hits = np.flatnonzero(s.word >= 0)
                line, doc, word = s.lines(hits), text_of(hits), s.word[hits]
                edges = np.flatnonzero(np.diff(line, prepend=-1))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(hits)], strict=False):  # no edge, no line
                    if in_prefix[word[a:b]].any():
                        block = set(word[a:b].tolist())
                        found = join.matches(block, len(block))
                        for k, c in found.items():
                            labels[doc[a]].add(join.label[k])
                            score[doc[a]] = max(score[doc[a]], c)
                end = s.first[doc + 1]
                for k, label in enumerate(join.label):
                    for a, c in _windows(join, k, word, hits, line, end):
                        labels[doc[a]].add(label)
                        score[doc[a]] = max(score[doc[a]], c)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, n_docs),
                        pa.array(np.diff(s.first)),
                        pa.array(count),
                        pa.array(low, mask=none),
                        pa.array(high, mask=none),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x)) for x in labels]),
                        pa.array(score),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )
        release()

    return run


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Labels of every whole text: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of the phrases. ``labels`` are the phrases' and those of the
    templates that a block of the text holds, also where a notice is wrapped over lines; ``score`` is the highest containment found, 1 for a
    phrase, 0 without any. Templates and phrases are a bounded list that goes to every task; the
    corpus gives them their order, counted over all rows. Null and empty texts have no word and
    no label. Null ids stay null, repeated rows give repeated rows, other columns are left out,
    an empty table gives an empty one.
    """
    wordings = [(label, _words(t)) for label, t in (TEMPLATES if templates is None else templates)]
    spoken = [(_words(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    vocabulary = sorted({w for _, t in wordings for w in t} | {w for t, _ in spoken for w in t})
    number = {w: k for k, w in enumerate(vocabulary)}
    bounded(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    counted = rows.select("text").mapInArrow(_frequencies(vocabulary, slice_bytes), "word long, n long").groupBy("word").sum("n").collect()  # one row a vocabulary word
    counts = [0] * len(vocabulary)
    for w, n in counted:
        counts[w] = n
    join = Join([(label, [number[w] for w in t]) for label, t in wordings], counts, threshold)
    return rows.mapInArrow(_scan(vocabulary, [([number[w] for w in t], label) for t, label in spoken], join, slice_bytes), SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Tokens of two tokenizers aligned by bytes, and how often their ids are linked in the corpus.

1. Texts are cut at spaces that no token of either tokenizer crosses; each distinct piece is
   encoded by both and aligned once per worker. A slice of documents then gives a row for each
   document and, for each id of side A in it, a row of postings: the ids of side B linked with it,
   and by document how often.
2. How many documents hold a pair is summed, within each task first, and meets by id of side A:
   at most the vocabulary of side B an id, with the highest count.
3. Postings are dealt by id of side A and stream, sorted, behind that id's counts, so a task holds
   one id's counts and a batch of postings. An id with a large share of all postings is dealt to
   as many tasks as its share asks for, and its counts to each of them.
4. Each task sums what its ids contribute to a document and sends a slice's sums together; they
   are added up by document where the slice's documents are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm.bytewords import ragged, slices, sums
from lumenloom.llm.hot import bounded, release
from lumenloom.llm.spans import Known, Rows
from lumenloom.llm.units import Encoder, _after_wide_blank
from lumenloom.scratch import cut

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SLICE_BYTES = 4 << 20
#: Contributions that a task holds before it sums and emits them.
HELD = 1 << 21
_SPACE = 0x20
DOCUMENT = "row long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: Postings of one id of side A in one slice: linked ids of side B, in how many of the documents, then for each pair those documents' places and how often they have it. ``row`` names the slice in either kind of row.
POSTING = "a int, b array<int>, n array<int>, docs binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in f"{DOCUMENT}, {POSTING}".split(", ")]


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start in texts that each begin with a space, and each text's first piece. A piece begins with a space that follows no white space."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n:
        begin[1:n] = (data[1:] == _SPACE) & (data[:-1] > _SPACE)
        where = np.flatnonzero(begin)
        begin[where[_after_wide_blank(data, where)]] = False
    begin[at[:-1]] = True
    begin[n] = False
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, at)


def linked(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in A and in B of all pairs of tokens that share a byte, and the offsets at which tokens of both sides end.

    Between two neighbouring ends of either side lie bytes of one token of A and one of B, and a
    pair shares no more than one such stretch: so the stretches are the pairs.
    """
    both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # each end comes once from a side
    twice = np.append(both[1:] == both[:-1], False)[: len(both)]
    ends = both[~twice]
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), both[twice]


class Decimals:
    """Numbers below ``n`` as text, each with one more byte behind it for a mark."""

    def __init__(self, n: int):
        words = [b"%d " % k for k in range(n)]
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(words), np.uint8)

    def write(self, numbers: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers one after the other, each with its mark, and where each ends."""
        size = self.size[numbers]
        upto = np.cumsum(size)
        out = self.pool[ragged(self.begin[numbers], size)]
        out[upto - 1] = marks
        return out, upto


class Aligner:
    """Both tokenizers, and all that the pieces of a worker's texts give."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None, pattern: str | None):
        import sentencepiece

        self.a = Encoder(a_path, a_ranks, pattern, keep=0)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = _byte_level(self.a.tokenizer.get_vocab())
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces of side B reach over a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.b_space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.decimals = Decimals(max(len(self.a_bytes), len(self.b_bytes)))
        self.clear()
        self.known = Known(self._add, self.clear)

    def clear(self) -> None:
        #: by piece: whether both sides give its bytes, then tokens of A, of B, groups, links; its groups as text; its links, A in the upper half
        self.numbers, self.text, self.links = np.zeros((0, 5), np.int64), [], Rows(np.int64)

    def _add(self, new: list[bytes]) -> None:
        raw, size = b"".join(new), np.array([len(x) for x in new], np.int64)
        upto = np.cumsum(size)
        a, n_a = self.a._encode(np.frombuffer(raw, np.uint8), upto - size, upto)
        # the tokenizer puts a space before what it gets: it stands for the piece's first
        lists = [x or [self.b_space] for x in self.b.encode([x[1:].decode() for x in new], num_threads=1)]
        b, n_b = np.array([t for x in lists for t in x], np.int64), np.array([len(x) for x in lists], np.int64)
        good = self._same(raw, a, n_a, upto - size, self.a_bytes, self.a_size) & self._same(raw, b, n_b, upto - size, self.b_bytes, self.b_size)
        a, b = a[np.repeat(good, n_a)].astype(np.int64), b[np.repeat(good, n_b)]
        end, n_a, n_b = np.cumsum(np.where(good, size, 0)), np.where(good, n_a, 0), np.where(good, n_b, 0)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        i, j, common = linked(a_ends, b_ends)
        per = lambda ends: np.diff(np.searchsorted(ends, end, "right"), prepend=0)
        n_groups = per(common)
        n_links = n_a + n_b - n_groups
        self.numbers = np.concatenate([self.numbers, np.stack([good, n_a, n_b, n_groups, n_links], 1).astype(np.int64)])
        self.links.extend(a[i] << 32 | b[j], n_links)
        # both sides' ids in the order of their groups, A first; a comma inside a side of a group, else its end's mark
        group = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate([a, b])[order]
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        text, where = self.decimals.write(ids, np.where(last, np.where(group % 2, ord(";"), ord("|")), ord(",")))
        where, text = np.append(0, where)[np.append(0, np.cumsum(n_a + n_b))].tolist(), text.tobytes()
        self.text += [text[x : y - 1] if y > x else b"" for x, y in zip(where[:-1], where[1:], strict=True)]

    def _same(self, raw: bytes, ids: np.ndarray, n: np.ndarray, at: np.ndarray, table: list[bytes], size: np.ndarray) -> np.ndarray:
        """Of which pieces the tokens' bytes are the piece."""
        back = [table[k] for k in ids.tolist()]
        ends = np.append(0, np.cumsum(size[ids]))
        if np.array_equal(ends[np.cumsum(n)], np.append(at[1:], len(raw))) and b"".join(back) == raw:
            return np.ones(len(n), bool)
        first = (np.cumsum(n) - n).tolist()
        return np.array([b"".join(back[f : f + m]) == raw[x:y] for f, m, x, y in zip(first, n.tolist(), at.tolist(), [*at[1:].tolist(), len(raw)], strict=True)])

    def slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: the four numbers and the digest of each, and all postings sorted by pair and document: pair, document, times."""
        n = len(at) - 1
        size = np.diff(at)
        full = np.flatnonzero(size > 0)
        # each text that has bytes gets a space before it
        own = np.append(0, np.cumsum(size[full] + 1))
        text = np.full(int(own[-1]), _SPACE, np.uint8)
        text[ragged(own[:-1] + 1, size[full])] = data
        starts, first = pieces(text, own)
        piece = self.known.numbers(text, starts, np.append(starts[1:], len(text)))
        good = sums(1 - self.numbers[piece, 0], first) == 0
        numbers = np.zeros((n, 4), np.int64)
        for k in range(4):
            numbers[full, k] = np.where(good, sums(self.numbers[piece, k + 1], first), 0)
        digests = [""] * n
        for k in np.flatnonzero(good).tolist():
            digests[full[k]] = hashlib.sha256(b";".join([self.text[p] for p in piece[first[k] : first[k + 1]].tolist()])).hexdigest()
        doc = np.repeat(full, np.diff(first))
        use = np.repeat(good, np.diff(first))
        both, often = np.unique(doc[use] * len(self.text) + piece[use], return_counts=True)
        doc, piece = both // len(self.text), both % len(self.text)
        pair, per = self.links.take(piece)
        doc, times = np.repeat(doc, per), np.repeat(often, per)
        order = np.lexsort((doc, pair))
        pair, doc, times = pair[order], doc[order], times[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        return numbers, digests, pair[begin], doc[begin], np.add.reduceat(times, begin) if len(begin) else times


def _byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """Each id's bytes; in a byte-level vocabulary printable Latin-1 stands for itself and every other byte, in turn, for a code point from 256."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in itself} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in itself)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for word, k in vocabulary.items():
        out[k] = bytes(of[c] for c in word) if all(c in of for c in word) else b""
    return out


@functools.cache
def aligner(a_path: str, b_path: str, a_ranks: str | None, pattern: str | None) -> Aligner:
    """This worker's; what it knows serves all tasks that the worker gets."""
    return Aligner(a_path, b_path, a_ranks, pattern)


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int32)))


def _blobs(values: np.ndarray, edges: np.ndarray, kind: str = "<i4") -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * int(kind[2:])).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[x].cast(k) if x in columns else pa.nulls(n, k) for x, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def _measured(files: tuple, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch.column(1), slice_bytes):
                numbers, digests, pair, doc, times = aligner(*files).slice(part.data, part.at)
                n = len(part)
                yield _batch({"row": pa.array(np.full(n, base)), "place": pa.array(np.arange(n)), "doc_id": batch.column(0).slice(part.first, n), **{x: pa.array(numbers[:, k]) for k, x in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": pa.array(digests)}, n)
                if len(pair):
                    pairs = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
                    a, b = pair[pairs[:-1]] >> 32, pair[pairs[:-1]] & 0xFFFFFFFF
                    ids = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
                    m = len(ids) - 1
                    yield _batch({"row": pa.array(np.full(m, base)), "a": pa.array(a[ids[:-1]]), "b": _lists(b, ids), "n": _lists(np.diff(pairs), ids), "docs": _blobs(doc, pairs[ids]), "times": _blobs(times, pairs[ids])}, m)
                base += 1
        release()

    return run


def _flat(column: pa.Array, kind: str = "<i4") -> np.ndarray:
    """All values of a list column, or of one of blobs of integers."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, kind)


def _sizes(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _summed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Sums by document, a row for each slice: places, sums of counts, numbers of best links."""
    row, place, counts, best = map(np.concatenate, zip(*held, strict=True))
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
    row, place = row[begin], place[begin]
    edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    sums_of = lambda values: _blobs(np.add.reduceat(values[order], begin), edges, "<i8")
    return pa.RecordBatch.from_arrays([pa.array(row[edges[:-1]]), _blobs(place, edges), sums_of(counts), sums_of(best)], ["row", "places", "counts", "bests"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with what was contributed to them. A slice's contributions come before its documents, and its sums are held until the next slice."""
    current, total = None, np.zeros((2, 0), np.int64)
    for batch in batches:
        rows = batch.column("row").to_numpy()
        tag = batch.column("tag").to_numpy(zero_copy_only=False)
        runs = np.append(np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (tag[1:] != tag[:-1]))), len(rows))
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            if current != rows[a]:
                current, total = rows[a], np.zeros((2, 0), np.int64)
            some = batch.slice(a, b - a)
            if tag[a] == 0:
                place = _flat(some.column("places"))
                more = int(place.max()) + 1 - total.shape[1]
                total = np.pad(total, ((0, 0), (0, max(0, more))))
                for k, name in enumerate(("counts", "bests")):
                    np.add.at(total[k], place, _flat(some.column(name), "<i8"))
            else:
                place = some.column("place").to_numpy()
                sums_of = np.pad(total, ((0, 0), (0, max(0, int(place.max()) + 1 - total.shape[1]))))[:, place]
                out = {x: some.column(x) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(sums_of[1]), "count_sum": pa.array(sums_of[0]), "groups_sha256": some.column("groups_sha256")}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    release()


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What postings add to their documents. An id's counts come before its postings; of the ids that a batch has counts of, and of the last before it, the counts are held."""
    keys, count, top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    held, size = [], 0
    for batch in batches:
        tag = batch.column("tag").to_numpy(zero_copy_only=False)
        counts, postings = batch.filter(pa.array(tag == 0)), batch.filter(pa.array(tag == 1))
        if counts.num_rows:
            a = counts.column("a").to_numpy().astype(np.int64)
            # the last id goes on; its counts may come again, for another share of its postings
            last = keys >> 32 == (keys[-1] >> 32 if len(keys) else -1)
            per = _sizes(counts.column("b"))
            own = np.repeat(a, per) << 32 | _flat(counts.column("b"))
            n = counts.column("total").flatten().to_numpy()
            best = n == np.repeat(counts.column("best").to_numpy(), per)
            keys, one = np.unique(np.concatenate([keys[last], own]), return_index=True)
            count, top = np.concatenate([count[last], n])[one], np.concatenate([top[last], best])[one]
        if postings.num_rows:
            per, n = _sizes(postings.column("b")), _flat(postings.column("n")).astype(np.int64)
            pair = np.repeat(postings.column("a").to_numpy().astype(np.int64), per) << 32 | _flat(postings.column("b"))
            where = np.searchsorted(keys, pair)
            row, place = np.repeat(np.repeat(postings.column("row").to_numpy(), per), n), _flat(postings.column("docs"))
            times = _flat(postings.column("times")).astype(np.int64)
            held.append((row, place, times * np.repeat(count[where], n), times * np.repeat(top[where], n)))
            size += len(row)
            if size >= HELD:
                yield _summed(held)
                held, size = [], 0
    if size:
        yield _summed(held)
    release()


def align(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row, and the corpus' pairs ``a, best, b, total``.

    Side A is a byte-level vocabulary that gets a space and the text, side B one of pieces that
    puts the space itself. Special strings inside texts are plain text. Null and empty texts, and
    those that either side can't give back byte by byte (they hold U+2581), have no tokens and no
    digest. Null ids stay null; repeated rows are documents of their own; other columns are left
    out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = cut(rows.mapInArrow(_measured((a_path, b_path, a_ranks, pattern), slice_bytes), f"{DOCUMENT}, {POSTING}"), "postings")
    own = out.where("a is null").select(*[x.split()[0] for x in DOCUMENT.split(", ")])
    postings = out.where("a is not null").select("row", "a", "b", "n", "docs", "times")
    counts = postings.select("a", F.inline(F.arrays_zip("b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("total"))
    # at most side B's vocabulary an id
    counts = counts.groupBy("a").agg(F.max("total").alias("best"), F.sum("total").alias("weight"), F.collect_list(F.struct("b", "total")).alias("pairs"))
    counts = cut(counts.select("a", "best", "weight", F.col("pairs.b").alias("b"), F.col("pairs.total").alias("total")), "counts")
    shares = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    whole = counts.agg(F.sum("weight")).first()[0] or 1
    counts = counts.withColumn("tasks", F.expr(f"1 + weight * {shares} div {whole}").cast("int"))
    hot = F.broadcast(counts.where("tasks > 1").select("a", "tasks"))  # fewer than `shares` ids
    dealt = postings.join(hot, "a", "left").withColumn("task", F.pmod(F.xxhash64("row"), F.coalesce("tasks", F.lit(1))).cast("int"))
    told = counts.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = told.select("a", "task", F.lit(0).alias("tag"), none("long").alias("row"), "b", none("array<int>").alias("n"), none("binary").alias("docs"), none("binary").alias("times"), "total", "best")
    right = dealt.select("a", "task", F.lit(1).alias("tag"), "row", "b", "n", "docs", "times", none("array<bigint>").alias("total"), none("long").alias("best"))
    streams = left.unionByName(right).repartition("a", "task").sortWithinPartitions("a", "task", "tag")
    added = streams.mapInArrow(_contributions, "row long, places binary, counts binary, bests binary")
    documents = [x for x in DOCUMENT.split(", ") if not x.startswith("row")]
    left = added.select("row", F.lit(0).alias("tag"), "places", "counts", "bests", *[none(x.split()[1]).alias(x.split()[0]) for x in documents])
    right = own.select("row", F.lit(1).alias("tag"), *[none("binary").alias(x) for x in ("places", "counts", "bests")], *[x.split()[0] for x in documents])
    both = left.unionByName(right).repartition("row").sortWithinPartitions("row", "tag")
    return both.mapInArrow(_by_document, RESULT), counts.select("a", "best", "b", "total")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), files.path(A_FILE), files.path(B_FILE), files.path(A_RANKS), files.PATTERN)[0]

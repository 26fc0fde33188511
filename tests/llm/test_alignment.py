import bisect
import collections
import hashlib

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenloom.llm.alignment import A_FILE, A_RANKS, B_FILE, Aligner, _byte_level, align, linked

FILES = (P.path(A_FILE), P.path(B_FILE), P.path(A_RANKS), P.PATTERN)


def spans(parts):
    ends = np.cumsum([len(x) for x in parts]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def plain(rows):
    """Each document by itself, over its whole text."""
    a_side, b_side = Tokenizer.from_file(P.path(A_FILE)), sentencepiece.SentencePieceProcessor(model_file=P.path(B_FILE))
    a_side.encode_special_tokens = True
    table = _byte_level(a_side.get_vocab())
    docs, holds = [], collections.Counter()
    for doc, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [table[x] for x in a]
        b_bytes = [bytes([int(b_side.id_to_piece(x)[3:5], 16)]) if b_side.is_byte(x) else b_side.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            docs.append((doc, [], [], [], []))
            continue
        sa, sb = spans(a_bytes), spans(b_bytes)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([], []) for _ in ends]
        for side, own, ids in ((0, sa, a), (1, sb, b)):
            for (_, e), x in zip(own, ids, strict=True):
                groups[bisect.bisect_left(ends, e)][side].append(x)
        links, j = [], 0
        for (s, e), x in zip(sa, a, strict=True):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and sb[k][0] < e:
                links.append((x, b[k]))
                k += 1
        holds.update(set(links))
        docs.append((doc, a, b, groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    for doc, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield doc, len(a), len(b), len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


ROUGH = ["a▁b", " lead", "tail ", "  ", " ", "\n", "\r\n a\r b", "Hello,  world\n\n it's  2024 <|endoftext|> ok <s> x", "　wide 　 blank", "日本 語 ①é", "\x00\x01 \x7f", "don't; (x) {\r }\r", "é́ ﬁ", "🙂 🙂🙂"]


def test_rough_rows(spark, hard, empty):
    more = spark.createDataFrame(list(enumerate(ROUGH, 100)), "doc_id long, text string")
    docs = hard.withColumns({"a": F.lit(1), "row": F.lit("clash")}).unionByName(more, allowMissingColumns=True)
    got, pairs = align(docs, *FILES, slice_bytes=300)
    assert order(got.collect()) == order(plain([(r.doc_id, r.text) for r in docs.collect()]))
    assert all(max(r.total) == r.best and len(r.b) == len(set(r.b)) for r in pairs.collect())
    assert align(empty, *FILES)[0].count() == 0


def test_hot_ids_and_small_batches(spark):
    """A third of all postings are one word's."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat('the the ', if(id % 3 = 0, repeat('the ', 40), concat('word', id % 50, ' of ', id % 7)), '!') as text").repartition(6)
    want = order(plain([(r.doc_id, r.text) for r in docs.collect()]))
    assert order(align(docs, *FILES, slice_bytes=500)[0].collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # counts of an id and its postings come in several batches
    try:
        assert order(align(docs, *FILES)[0].collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_links_are_the_pairs_that_share_bytes():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.sort(rng.choice(np.arange(1, 40), rng.integers(0, 20), replace=False)) for _ in range(2))
        a, b = np.append(a, 40), np.append(b, 40)
        i, j, common = linked(a, b)
        starts = [np.append(0, x[:-1]) for x in (a, b)]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(starts[0][x], starts[1][y]) < min(a[x], b[y])]
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
        assert common.tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_a_worker_starts_anew():
    import pyarrow as pa

    from lumenloom.llm.bytewords import slices

    worker = Aligner(*FILES)
    part = next(slices(pa.array(["one two three", "two three four five"] * 5)))
    first = worker.slice(part.data, part.at)
    worker.known.keep = 1
    again = worker.slice(part.data, part.at)
    assert first[1] == again[1] and all(np.array_equal(x, y) for x, y in zip(first[2:], again[2:], strict=True))

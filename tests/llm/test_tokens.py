import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from lumenloom.llm.packing import Levels, Packer, pack_with_public_tokenizer
from lumenloom.llm.token_counts import TOKENIZER, token_counts
from lumenloom.llm.units import Encoder, cuts


def ids_of(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text, add_special_tokens=False).ids


def test_counts(spark, hard, empty):
    got = token_counts(hard, P.path(TOKENIZER)).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(ids_of(TOKENIZER, r.text or ""))) for r in hard.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts(empty, P.path(TOKENIZER)).count() == 0


def test_pieces_give_the_ids_of_whole_texts():
    texts = ["Hello,  world\n\n it's  2024 <|endoftext|> ok   x", " lead", "tail \n", "a　 b", "日本 語 text", "x" * 5000, ""]
    encoder = Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for _ in range(2):
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            starts, _ = cuts(data, np.array([0, len(data)]))
            got, _ = encoder.ids(data, starts[starts < len(data)])
            assert got.tolist() == ids_of("byte_bpe_50k.json", t), t


def test_packing(spark, hard, empty):
    rows = pack_with_public_tokenizer(hard).collect()
    ids = {}
    for r in hard.collect():
        ids.setdefault(r.doc_id, []).append(ids_of("byte_bpe_50k.json", r.text or "") + [1])
    for doc, lists in ids.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc)
        assert sum(n for _, n, _, _ in own) == sum(map(len, lists))
        for start, n, crc, total in own:
            assert any(total == len(x) and zlib.crc32(np.array(x[start : start + n], "<u4").tobytes()) == crc for x in lists)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert pack_with_public_tokenizer(empty).count() == 0


def test_levels_choose_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    levels = Levels(32)
    for r in rng.integers(1, 33, 400).tolist():
        def cost(h, r=r):
            n = levels.count.copy()
            if h:
                n[h] -= 1
            if h + r < 32:
                n[h + r] += 1
            return int((n[1:32] ** 2).sum())

        options = [h for h in range(0, 33 - r) if h == 0 or levels.count[h]]
        h = levels.choose(r)
        assert h in options and cost(h) == min(map(cost, options))
        levels.take(h)
        if h + r < 32:
            levels.put(h + r, [])


def test_packer_leaves_no_padding_and_loses_nothing():
    rng = np.random.default_rng(2)
    packer, sizes = Packer(0, 64), rng.integers(1, 200, 300).tolist()
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n, dtype="<u4"))
    packer.finish()
    fill = {}
    for _, _, n, _, _, sequence, _ in packer.rows:
        fill[sequence] = fill.get(sequence, 0) + n
    assert sum(fill.values()) == sum(sizes)
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values())

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenloom.llm import spans
from lumenloom.llm.bytewords import slices
from lumenloom.llm.token_files import PAGE_ROWS, TOKENIZER, _sums, read_documents, read_index, read_span, write_tokens
from lumenloom.llm.word_ids import WordIds

PARTS = ["don't", "DON'T", "it's'", "''s", "!'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "a1b22", "x≠", "x" + "≠", "é", "É", "  ", "\n", " ", "　", "日本", "'re", "'REx", "1'd", "<|", "|>", "K", "ſ", "İ", "Σ", "ΑΣ", "...", "-", "\x00", "\x1c", "\u0085", "a", "Z", "9", "½", "ʼs", "'", "ǅ", "ƻ", "×", "Word,"]


def want(text):
    return Tokenizer.from_file(P.path(TOKENIZER)).encode(text, add_special_tokens=False).ids


def test_units_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["x" * 5000, ""]
    words, tokenizer = WordIds(P.path(TOKENIZER)), Tokenizer.from_file(P.path(TOKENIZER))
    words.known.keep = 300  # starts anew now and then
    for part in slices(pa.array(texts), 2000):
        ids, sizes = words.ids(part.data, part.at)
        for k, own in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
            text = texts[part.first + k]
            assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_spans_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(spans, "spans_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"one two one twice", np.uint8)
    found, where = spans.distinct_spans(data, np.array([0, 4, 8, 12]), np.array([3, 7, 11, 17]))
    assert [found[k] for k in where] == [b"one", b"two", b"one", b"twice"]


def plain(rows):
    at = 0
    for doc, text in rows:
        ids = want(text or "") + [2]
        yield doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_files_read_back(spark, hard, empty, tmp_path):
    docs = hard.withColumns({"shard": F.lit(1), "at": F.lit("clash")})
    write_tokens(docs, str(tmp_path / "a"), P.path(TOKENIZER))
    got = sorted((tuple(r) for r in read_documents(spark, str(tmp_path / "a")).mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in hard.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == list(plain(rows))
    write_tokens(empty, str(tmp_path / "b"), P.path(TOKENIZER))
    assert read_documents(spark, str(tmp_path / "b")).count() == 0
    assert read_index(spark, str(tmp_path / "b")).count() == 0
    assert read_span(spark, str(tmp_path / "b"), 0, 10).count() == 0


def test_layout_and_selective_reads(spark, tmp_path):
    path = str(tmp_path / "c")
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text number ', id, ' and some more words') as text")
    write_tokens(docs.repartition(3), path, P.path(TOKENIZER), files=3)
    files = [pq.ParquetFile(f) for f in sorted(Path(path, "tokens").glob("*.parquet"))]
    assert sum(f.metadata.num_rows for f in files) == 6000 and len(files) == 3
    for f in files:
        columns = {f.metadata.row_group(0).column(k).path_in_schema: f.metadata.row_group(0).column(k) for k in range(5)}
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "at", "n_tokens"))
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    firsts = [(r.first_doc, r.last_doc) for r in read_index(spark, path).orderBy("shard").collect()]
    assert all(a[1] < b[0] for a, b in zip(firsts, firsts[1:], strict=False))

    some = read_documents(spark, path, 1000, 1002).orderBy("doc_id")
    assert [r.doc_id for r in some.collect()] == [1000, 1001, 1002]
    plan = some._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(doc_id,1000)" in plan.toString()
    scanned = sum(int(s.metrics().apply("numOutputRows").value()) for s in _scans(spark, plan))
    assert 0 < scanned <= 4 * PAGE_ROWS  # pages of the files that hold the bounds, of 6000 rows
    assert "ids" not in str(read_documents(spark, path, ids=False)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1])

    every = [x for r in read_documents(spark, path).orderBy("start").collect() for x in r.ids]
    for start, n in ((0, 5), (17, 100), (len(every) // 2, 1000), (len(every) - 3, 50), (len(every), 5)):
        assert [x for r in read_span(spark, path, start, n).orderBy("start").collect() for x in r.ids] == every[start : start + n]


def _scans(spark, plan):
    """The file scans below a plan that ran."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec" and node.metrics().contains("numOutputRows") and "tokens" in node.toString():
            found.append(node)
        elif name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found

import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenloom.scratch import cut
from test_dedup import BLANK, brute_force

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)


def sound(k: int, n: int = 60) -> str:
    return " ".join(f"w{k}x{j:05d}" for j in range(n))


@pytest.fixture(scope="module")
def rough(spark, hard):
    """The hard rows, and sound ones among which are copies, near copies, rows alike without an id, and a very long text."""
    rows = [
        (10, sound(1), "en", "a"), (11, sound(1) + "\n", "en", "a"), (12, sound(1) + " w1x99999", None, None), (None, sound(2), "en", None), (None, sound(2), "en", None),
        (13, sound(3), "de", "b"), (5, sound(4), "en", "b"), (14, sound(5, 30_000), "fr", "c"),
    ]
    more = spark.createDataFrame([(*r, 7, "x") for r in rows], hard.schema)
    return cut(hard.unionByName(more).repartition(3), "rough")


def rows_of(df) -> list[tuple]:
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def same(a: list, b: list) -> bool:
    return Counter(a) == Counter(b)


def test_quality_stage(spark, rough):
    out = STAGES["quality_rules"](spark, rough, SF)
    assert out.columns == rough.columns
    assert same(rows_of(out), [r for r in rows_of(rough) if (r[1] or "").startswith("w") and len(WORD.findall(r[1])) >= 50 and "x" in r[1]])


def test_exact_stage(spark, rough):
    out, groups = STAGES["exact_dedup"](spark, rough, SF), defaultdict(list)
    for r in rows_of(rough):
        groups[BLANK.sub("", r[1] or "")].append(r)
    best = [min((-len(r[1] or ""), r[0] is None, r[0] or 0) for r in g) for g in groups.values()]
    assert out.columns == rough.columns
    assert same([(-len(t or ""), i is None, i or 0) for i, t, _ in rows_of(out)], best)


def test_near_stage(spark, rough):
    rows = rows_of(rough)
    groups = defaultdict(list)
    for place, (n, component) in brute_force([(k, r[1]) for k, r in enumerate(rows)], 5).items():
        groups[component if n else ("alone", place)].append(rows[place])
    out = STAGES["near_dedup"](spark, rough, SF)
    assert out.columns == rough.columns
    assert same([(i is None, i or 0) for i, _, _ in rows_of(out)], [min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()])


def targets(sizes: dict, share: float = 1.5, most: int = 2) -> dict:
    """What each source should give: by weight, nobody above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, out = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, share * sum(sizes.values()), {}
    free = set(order)
    while free:
        each = left / sum(weight[s] for s in free)
        full = {s for s in free if each * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: each * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def test_mixing_stage(spark, rough):
    out, sizes, given = STAGES["mix_sources"](spark, rough, SF), Counter(), Counter()
    for _, text, source in rows_of(rough):
        sizes[source] += len(WORD.findall(text or ""))
    taken = rows_of(out)
    for _, text, source in taken:
        given[source] += len(WORD.findall(text or ""))
    assert out.columns == rough.columns
    for source, target in targets(sizes).items():
        assert abs(given[source] - target) <= 1.5, source
    whole = Counter((r[0], r[1]) for r in rows_of(rough))
    texts = {t for _, t in whole}
    assert all(n <= 2 * whole[(i, t)] for (i, t), n in Counter((i, t) for i, t, _ in taken if t in texts).items())


def test_packing_stage(spark, rough):
    import public_tokenizers

    encoder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows, pieces = rows_of(rough), STAGES["pack_sequences"](spark, rough, SF).collect()
    want = Counter((i, len(encoder.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in want.items())
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables(spark, hard, name):
    none = hard.limit(0)
    out = STAGES[name](spark, none, SF)
    assert out.count() == 0 and (name == "pack_sequences" or out.columns == none.columns)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "pack_sequences":
            assert docs.columns == columns
        rows = docs.collect()
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in before.collect():
                groups[re.sub(r"[\x20\x09-\x0D]+", "", r.text)].append((-len(r.text), r.doc_id))
            assert sorted(r.doc_id for r in rows) == sorted(min(g)[1] for g in groups.values())
        if name == "mix_sources":
            size = sum(len(WORD.findall(r.text)) for r in before.collect())
            assert abs(sum(len(WORD.findall(r.text)) for r in rows) - 1.5 * size) <= 20
    assert seen["pack_sequences"].agg({"length": "sum"}).first()[0] > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_a_stage_that_is_written_leaves_no_other_table(spark, monkeypatch):
    from lumenloom.scratch import new_path, written

    path = new_path(spark, "docs")
    spark.range(10).write.parquet(f"{path}/documents.parquet")
    one = lambda spark, docs, sf_dir: cut(docs, "own").selectExpr("id + 1 AS id")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", one), ("b", one), ("c", lambda spark, docs, sf_dir: docs)])
    before = written()
    out = corpus_pipeline.run(spark, path)
    assert len(written() - before) == 1 and sorted(r.id for r in out.collect()) == list(range(2, 12))


def test_mixing_writes_no_text(spark, rough):
    """Rows are read again from the table given, not written beside it with their sizes."""
    from lumenloom.scratch import written

    before = written()
    assert STAGES["mix_sources"](spark, rough, SF).count() > 0
    left = [spark.read.parquet(p).columns for p in written() - before]
    assert left and not any({"row", "text"} & set(c) for c in left)

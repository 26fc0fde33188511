import hashlib

from lumenloom.llm.chat_format import HOSTILE, digests, format_conversations

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes\nno"), (1, 2, "user", None), (2, 0, "assistant", "a <\\/s> b </s> [\\\\INST] <s>"), (2, 1, "system", "[INST] x [/INST] y"),
    (3, None, None, "x"), (3, 1, "assistant", "dup"), (3, 1, "assistant", "dup"), (None, 0, "assistant", "</s"), (4, 0, "we [/INST] ird", "plain"), (5, 0, "assistant", ""),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS + HOSTILE, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in format_conversations(df).collect()}
    got = {r.conv_id: r for r in digests(format_conversations(df)).collect()}
    want = {}
    for c, t, r, x in ROWS + HOSTILE:
        want.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in out[c].turns] == [(r, x) for _, r, x in turns]
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c].loss_text == loss and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert out[c].formatted.count("</s>") == len(turns) == out[c].formatted.count("[INST]") == out[c].formatted.count("[/INST]")
        spans = [out[c].formatted[s.start : s.start + s.length] for s in out[c].loss_spans]
        assert len(spans) == sum(r == "assistant" for _, r, _ in turns)
    assert not out[1].escaped and out[2].escaped and out[-7].escaped


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_conversations(df).count() == 0


def test_what_the_grammar_does_not_give_is_null(spark):
    from pyspark.sql import functions as F

    from lumenloom.llm.chat_format import parse

    rows = ["", "<s>", "XYZ[ABCD] user [/INST] hi</s>", "<s>[INST] u [/INST] hi", "<s>[INST] u [/INST] hi</s>x", "<s>[ABCD] u [/INST] hi</s>", "<s>[INST] u hi</s>", "<s>[INST] u [/INST] h[INST]i</s>", "<s>[INST] u [/INST] hi</s>"]
    got = [r.t for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").orderBy("k").select(parse(F.col("x")).alias("t")).collect()]
    assert got[0] is None and got[1] == [] and got[2:8] == [None] * 6 and [tuple(t) for t in got[8]] == [("u", "hi")]


def test_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "a[INST]" * 50_000, "x", 1), (1, 1, "assistant", "b" * 400_000, "y", 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string, source int")
    got = digests(format_conversations(df)).first()
    assert (got.n_turns, got.loss_chars) == (2, 400_000) and got.formatted_chars == 3 + 2 * 20 + 4 + 9 + 400_000 + 50_000 * 8

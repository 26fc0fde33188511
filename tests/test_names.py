import random

import pytest

from lumenloom.operators import names as N

SCHEMA = "channel_key string, copy_index int, want string"


def served(rows, numbered):
    """The plain model: one row after the other takes its wish or the next number."""
    used, out = set(), {}
    for key, copy, want in sorted(rows):
        name, n = want, 1
        while name.lower() in used:
            n += 1
            name = numbered(want, n)
        used.add(name.lower())
        out[key, copy] = name
    return out


def dotted(want, n):
    head, _, tail = want.rpartition(".")
    return f"{head}.{n}.{tail}" if "." in want and len(tail) == 2 and tail.isalpha() else f"{want}.{n}"


def given(spark, rows, form, log=None):
    out = N.unique_names(spark.createDataFrame(rows, SCHEMA).repartition(3), "want", form, "name", log)
    return {(r.channel_key, r.copy_index): r.name for r in out.collect()}


CHAINS = [
    ["A", "A", "A 2", "a", "A 2", "A 2 2"],
    ["A 2", "A 3", "A 5", "A", "A", "A", "A", "A 4", "A 4"],
    ["A", "a 2", "A", "A 3", "A", "A 2 2", "A 2", "A 2"],
    ["A 02", "A 1", "A 2 ", "A", "A", "A", "", "", " 2", " 2"],
    ["A 99999999999999999999", "A", "A", "A 999999999999999999"],
    ["A"] * 9 + ["A 3 2", "A 3", "A 3"],
]


@pytest.mark.parametrize("wishes", CHAINS)
def test_chained_clashes(spark, wishes):
    rows = [(f"k{i:03}", 0, w) for i, w in enumerate(wishes)]
    assert given(spark, rows, N.SPACED) == served(rows, lambda w, n: f"{w} {n}")


@pytest.mark.parametrize("seed", range(4))
def test_random_clashes(spark, seed):
    rng = random.Random(seed)
    spaced = [rng.choice("AaB") + "".join(f" {rng.randint(1, 5)}" for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3]))) for _ in range(150)]
    rows = [(f"k{rng.randint(0, 60):02}", i, w) for i, w in enumerate(spaced)]
    log = []
    assert given(spark, rows, N.SPACED, log) == served(rows, lambda w, n: f"{w} {n}")
    assert log and max(log) <= len({w.lower() for w in spaced if w[-1].isdigit()})
    ids = [(k, c, w.replace(" ", ".") + rng.choice([".tr", ".TR", "", ".x2"])) for k, c, w in rows]
    assert given(spark, ids, N.DOTTED) == served(ids, dotted)


def test_rows_that_meet_none_are_not_written_in_rounds(spark):
    rows = [(f"k{i:04}", 0, f"Channel {i}") for i in range(2, 400)] + [("x", 0, "B"), ("y", 0, "B"), ("z", 0, "B 2")]
    log = []
    assert given(spark, rows, N.SPACED, log) == served(rows, lambda w, n: f"{w} {n}")
    assert set(log) == {1}


def test_a_wish_with_a_third_of_all_rows(spark):
    rows = [(f"k{i:05}", i % 3, "Hot" if i % 3 == 0 else f"Hot {i}" if i % 7 == 0 else f"n{i}") for i in range(3000)]
    assert given(spark, rows, N.SPACED) == served(rows, lambda w, n: f"{w} {n}")


def test_nulls_and_no_rows(spark):
    assert given(spark, [("a", 0, None), ("b", 0, None), ("c", 0, "X")], N.SPACED) == {("a", 0): None, ("b", 0): None, ("c", 0): "X"}
    assert given(spark, [], N.SPACED) == {}

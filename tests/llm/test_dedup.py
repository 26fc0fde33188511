import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenloom.llm.exact_dedup import drop_exact, exact_groups, rice_decode, rice_encode
from lumenloom.llm.near_dedup import common_sizes, drop_near, near_groups
from lumenloom.operators.graph import components

BLANK = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=50, deadline=None)
def test_rice_code(values):
    v = np.array(sorted(values), np.uint64)
    blob, low = rice_encode(v)
    assert np.array_equal(rice_decode(blob, low, len(v)), v)


def test_exact(spark, hard, empty):
    rows = hard.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[BLANK.sub("", r.text or "")].append(r)
    got = exact_groups(hard).collect()
    assert len(got) == len(rows)
    want = sorted((r.doc_id or -1, len(g)) for g in groups.values() for r in g)
    assert sorted((r.doc_id or -1, r.group_size) for r in got) == want
    for g in groups.values():
        best = min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        mine = [r for r in got if any(r.doc_id == x.doc_id for x in g)]
        assert sum(r.kept for r in mine) == 1 and {r.keep_id for r in mine} == {best.doc_id}
    kept = drop_exact(hard)
    assert kept.columns == hard.columns and kept.count() == len(groups)
    assert exact_groups(empty).count() == 0 and drop_exact(empty).count() == 0


def shingles(text, k):
    w = [x for x in BLANK.split((text or "").translate(LOWER)) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_force(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a1, b1 = find(i), find(j)
                parent[max(a1, b1)] = min(a1, b1)
    return {i: (len(x), find(i)) for i, x in sets}


@pytest.fixture(scope="module")
def copies(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for size in (1, 1, 1, 2, 3, 60):
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(size):
            words = list(base)
            for p in rng.choice(120, int(rng.integers(0, 9)), replace=False):
                words[p] = str(rng.choice(vocabulary)).upper()
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "solo"), (n + 3, "Solo "), (n + 4, rows[5][1])]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, copies, k):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, k).collect()}
    assert got == brute_force(copies, k)
    kept = drop_near(df, k)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_near_hard(spark, hard, empty):
    got = near_groups(hard, 2).collect()
    assert len(got) == hard.count()
    assert {r.doc_id: r.component_id for r in got}[5] == 4
    assert near_groups(empty, 2).count() == 0


def test_common_sizes():
    rng = np.random.default_rng(0)
    a = [np.unique(rng.integers(0, 9000, 6000)) for _ in range(3)]
    b = [np.unique(rng.integers(0, 9000, n)) for n in (1, 50, 7000)]
    got = common_sizes(np.array([len(x) for x in a]), np.concatenate(a), np.array([len(x) for x in b]), np.concatenate(b))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 7), (200, 201), (202, 200), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 21)}, 100: 0, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_of_one_id_or_none_are_told_apart(spark):
    """Nothing is dropped but copies: different texts under one id all stay, copies without an id leave one."""
    rows = [(1, "a b c d e"), (5, "A b c d e"), (5, "completely different words here now"), (None, "no id at all here"), (None, "No id at all here"), (7, "no words shared with any"), (7, "no words shared with any")]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, best string, n int").repartition(3)
    kept = drop_near(df, 2)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text.lower()) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a b c d e"), (5, "completely different words here now"), (None, "no id at all here"), (7, "no words shared with any")], key=str)
    exact = sorted((r.text for r in drop_exact(df).collect()))
    assert exact == sorted({r[1] for r in rows})


def test_hot_keys_join_alike(spark):
    from pyspark.sql import functions as F

    from lumenloom.llm import hot
    from lumenloom.scratch import cut

    rows = cut(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), "id"), "rows")
    table = cut(rows.where("k < 400").groupBy("k").agg(F.count("*").alias("n")), "table")
    for how in ("inner", "left"):
        got = sorted(hot.join_hot(rows, table, ["k"], "n", how).select("k", "id", "n").collect(), key=str)
        assert got == sorted(rows.join(table, ["k"], how).select("k", "id", "n").collect(), key=str)


def test_buckets_are_the_same_whether_their_rows_are_dealt_or_reduced_where_they_are(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from lumenloom.llm import near_dedup

    rng = random.Random(11)
    rows = [(1, k, k % 9 + 1) for k in range(700)]  # one key of many nodes, some of a few, most of one
    rows += [(2 + rng.randrange(300), k, 1) for k in range(700, 1000)] + [(1000 + k, k, 2) for k in range(4000)]
    rows = list({(key, node): (key, node, n) for key, node, n in rows}.values())
    members = spark.createDataFrame(rows, "key long, node long, n long").repartition(5).cache()
    by = {}
    for key, node, n in rows:
        by.setdefault(key, []).append((node, n))
    wanted = sorted((key, node, n, min(of), len(of)) for key, of in by.items() if len(of) > 1 for node, n in of)
    for least in (256, 10**6):  # the large key is hot, and is not
        monkeypatch.setattr(near_dedup, "LEAST", least)
        met = near_dedup._met(members).cache()
        got = sorted((r.key, r.node, r.n, tuple(r.center), r.c) for r in met.collect())
        assert got == wanted
        assert all(r.x == 1 for r in met.groupBy("key").agg(F.count_distinct("x1", "x2").alias("x")).collect())
    shown = near_dedup._met(members)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # what is dealt by key is no wider than the rows are
    at = next(k for k, line in enumerate(shown) if "RepartitionByExpression [key" in line)
    assert not any("xxhash64(node" in line or "struct" in line for line in shown[at:] if "Repartition" not in line and "Filter" not in line)


@pytest.mark.parametrize("block", [4, 128])
def test_clusters_by_blocks_and_by_buckets_are_the_same(spark, copies, monkeypatch, block):
    """Of a cluster that fits into a block each text is dealt once; larger ones go by buckets."""
    from lumenloom.llm import near_dedup

    by_buckets, star = [], near_dedup._star_links
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "_star_links", lambda shared, *a: by_buckets.append(shared.select("node").distinct().count()) or star(shared, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(spark.createDataFrame(copies, "doc_id long, text string").repartition(3), 2).collect()}
    assert got == brute_force(copies, 2)
    if block == 4:
        assert len(by_buckets) == 1 and by_buckets[0] > 4
    else:
        assert not by_buckets


def test_near_stage_leaves_the_rows_and_no_band_keys(spark, copies):
    from pyspark.sql import functions as F

    from lumenloom.scratch import written

    before = written()
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    kept = drop_near(df.withColumn("more", F.col("doc_id")), 2)
    assert kept.count() > 0
    left = [spark.read.parquet(p).columns for p in written() - before]
    assert sum("c1" in c for c in left) == 1 and not any("keys" in c for c in left)

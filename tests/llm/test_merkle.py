import hashlib
import zlib

from pyspark.sql import functions as F

from lumenloom.llm.merkle import Partials, folded, manifest, parent_of, tree_of, verified_documents

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, k):
    for level in tree[:-1]:
        run = level[k // 8 * 8 : k // 8 * 8 + 8]
        yield run[: k % 8], run[k % 8 + 1 :]
        k //= 8


def plain(rows):
    groups = {}
    for r in rows:
        bad = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "") if bad else r["text"]
        groups.setdefault(r["lang"], []).append((r["doc_id"] is None, r["doc_id"] or 0, leaf(r), r["doc_id"], leaf(r | {"text": low})))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[g])]) for g in names]
    top = levels([t[-1][0] for t in trees])
    for n, g in enumerate(names):
        for k, (_, _, own, doc, seen) in enumerate(sorted(groups[g])):
            path = [*siblings(trees[n], k), *siblings(top, n)]
            for left, right in path:
                seen = h("".join([*left, seen, *right]))
            yield doc, own, trees[n][-1][0], top[-1][0], h("".join(d for a, b in path for d in a + b)), seen, seen == top[-1][0]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_rough_rows(spark, hard, empty):
    docs = hard.withColumn("n_chars", F.when(F.col("doc_id") != 4, F.length("text"))).withColumns({"index": F.lit(1), "n": F.lit("clash")})
    got = order(verified_documents(docs).collect())
    assert got == order(plain([r.asDict() for r in docs.collect()]))
    assert verified_documents(empty.withColumn("n_chars", F.lit(0))).count() == 0
    assert verified_documents(docs.where("doc_id = 4")).first().root == got[3][1]  # one row: its leaf is the root


def test_a_hot_group_many_groups_and_tampering(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('g', id % 20)) as lang", "if(id % 7 = 0, null, 's') as source", "if(id % 2 = 0, concat('Text ', id), concat('text ', id)) as text", "id as n_chars").repartition(5)
    got = verified_documents(docs).collect()
    assert order(got) == order(plain([r.asDict() for r in docs.collect()]))
    assert {r.verified for r in got} == {True, False}
    assert all(r.verified for r in got if r.doc_id % 2)  # without capitals nothing is tampered with


def test_rounds_and_paths_do_not_change_the_tree(spark):
    rows = spark.range(3000).select(tree_of(F.lit("a")).alias("tree"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")).repartition(7)
    want = levels([h(str(k)) for k in range(3000)])[-1][0]
    for subtree in (64, 8**6):  # three rounds, and two
        found = manifest(rows, subtree=subtree)
        assert found.root.hex() == want
        assert all(folded(bytes(r.digest), bytes(r.path)).hex() == want for r in found.proofs().collect())
    assert found.links.count() == 375 + 47 + 6 + 1


def test_parents_are_emitted_when_the_last_child_comes():
    partials = Partials(8)
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(10)]
    for k in (9, 1, 0, 7, 6, 5, 4, 3, 2):
        partials.add("t", 10, 0, k, digests[k])
    assert [(r[0], r[3], r[4]) for r in partials.rows] == [(1, 1, 0)]
    partials.add("t", 10, 0, 8, digests[8])
    assert [(r[0], r[3], r[4]) for r in partials.rows] == [(1, 1, 0), (1, 1, 1), (1, 2, 0), (2, 2, 0)]
    assert partials.rows[-1][5] == parent_of([parent_of(digests[:8]), parent_of(digests[8:])])
    assert not partials.waiting

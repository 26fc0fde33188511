"""A Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups' roots.

Leaves are numbered within their group. Children meet by their parent's key, as in a combine by
key that is driven by events: a task adds digests to partial parents, and a parent that has all
the children that the group's size gives it is emitted at once, together with the link to its
children, and is itself an event of the level above. What a task can't complete, a few nodes a
level since leaves come in ranges, is its frontier: that is dealt by an ancestor and goes on in
the next round, where whole subtrees meet, and in a third, where a large tree's subtrees do. Links read in reverse give the proofs: a
block of 4096 leaves needs the links inside it and the path of the block's own node, so paths are
made from the top in bands of four levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm.hot import join_hot, release
from lumenloom.operators.ranks import with_rank
from lumenloom.scratch import cut, drop

ARITY = 8
#: Levels of a block whose paths one task makes at once.
BAND = 4
#: Leaves of the subtrees by which a frontier is dealt first, and the most subtrees of one tree: more leaves make larger ones.
SUBTREE, MOST_SUBTREES = 8**6, 4096
_BATCH_ROWS = 4096
NODE = "tree string, size long, level int, index long, digest binary"
#: ``done`` 1: the parent ``index`` of ``level`` with its children's digests; 2: a group's root; 0: a node that waits for its siblings.
EVENT = "done int, tree string, size long, level int, index long, digest binary"
_EVENT_KINDS = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_EVENT_NAMES = [x.split()[0] for x in EVENT.split(", ")]


def parent_of(children: list[bytes]) -> bytes:
    """The digest over the children's digests as lower-case hex."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def _width(size: int, level: int, arity: int) -> int:
    """Nodes of a level in a tree of ``size`` leaves."""
    return -(-size // arity**level)


class Partials:
    """Parents that wait for children, by tree, level and index. ``rows`` gets what is complete."""

    def __init__(self, arity: int):
        self.arity, self.waiting, self.rows = arity, {}, []

    def add(self, tree: str, size: int, level: int, index: int, digest: bytes) -> None:
        while True:
            width = _width(size, level, self.arity)
            if width == 1:
                self.rows.append((2, tree, size, level, index, digest))
                return
            parent = index // self.arity
            key = (tree, level + 1, parent)
            children = self.waiting.setdefault(key, (size, {}))[1]
            children[index] = digest
            if len(children) < min(self.arity, width - parent * self.arity):
                return
            del self.waiting[key]
            ordered = [children[k] for k in sorted(children)]
            level, index, digest = level + 1, parent, parent_of(ordered)
            self.rows.append((1, tree, size, level, index, b"".join(ordered)))

    def frontier(self) -> None:
        for (tree, level, _), (size, children) in self.waiting.items():
            self.rows += [(0, tree, size, level - 1, k, d) for k, d in sorted(children.items())]
        self.waiting = {}


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _EVENT_KINDS, strict=True)], _EVENT_NAMES)


def _combine(arity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials = Partials(arity)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                partials.add(*row)
            if len(partials.rows) >= _BATCH_ROWS:
                yield _table(partials.rows)
                partials.rows = []
        partials.frontier()
        if partials.rows:
            yield _table(partials.rows)
        release()

    return run


def _climb(nodes: DataFrame, arity: int, largest: int, subtree: int = SUBTREE) -> DataFrame:
    """All links and roots above the leaves ``nodes`` (of ``NODE``), as ``EVENT`` rows that are done; one written table a round."""
    rounds, todo, top = [], nodes.sortWithinPartitions("tree", "index"), 0
    while arity**top < max(subtree, largest / MOST_SUBTREES):
        top += 1
    while True:
        out = cut(todo.mapInArrow(_combine(arity), EVENT), "events")
        rounds.append(out.where("done > 0"))
        rest = out.where("done = 0").drop("done")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        level = F.greatest(F.lit(top), F.col("level") + 1)
        ancestor = F.floor(F.col("index") / F.pow(F.lit(float(arity)), level - F.col("level"))).cast("long")
        todo = rest.repartition("tree", ancestor).sortWithinPartitions("tree", "level", "index")
        top += 12  # the few subtrees' roots that a tree has now all meet


def _packed(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """Steps of a path from below: own place in the run, number of siblings, their digests."""
    return b"".join(bytes((place, len(others))) + b"".join(others) for place, others in steps)


def steps_of(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, k = [], 0
    while k < len(path):
        place, n = path[k], path[k + 1]
        out.append((place, [path[k + 2 + 32 * i : k + 34 + 32 * i] for i in range(n)]))
        k += 2 + 32 * n
    return out


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for place, others in steps_of(path):
        leaf = parent_of(others[:place] + [leaf] + others[place:])
    return leaf


def proof_digest(path: bytes) -> bytes:
    """The digest over all siblings of a path, as lower-case hex."""
    return hashlib.sha256(b"".join(d for _, others in steps_of(path) for d in others).hex().encode()).digest()


def _paths(base: int, arity: int):
    """For one block: the path of each of its nodes at level ``base``. Links of the block by level and index; level -1 is the path of the block's own node."""

    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        runs = {(level, index): digests for level, index, digests in zip(links["level"], links["index"], links["digest"], strict=True)}
        above = runs.pop((-1, 0), b"")
        cache: dict[tuple[int, int], bytes] = {}

        def path(level: int, index: int) -> bytes:
            if (level, index) not in cache:
                run = runs.get((level + 1, index // arity))
                if run is None:
                    cache[level, index] = above
                else:
                    others = [run[32 * k : 32 * k + 32] for k in range(len(run) // 32)]
                    place = index % arity
                    cache[level, index] = _packed([(place, others[:place] + others[place + 1 :])]) + path(level + 1, index // arity)
            return cache[level, index]

        return nodes.assign(path=[path(base, int(k)) for k in nodes["index"]]).drop(columns="block")

    return run


def _descend(leaves: DataFrame, links: DataFrame, tops: DataFrame, sizes: DataFrame, arity: int, largest: int) -> DataFrame:
    """``leaves(tree, index, ..)`` with ``path``. ``tops(tree, digest)`` are the paths above the trees' roots, ``sizes(tree, n)`` the trees."""
    bands = 1
    while arity ** (BAND * bands) < largest:
        bands += 1
    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "digest")
    for band in range(bands - 1, -1, -1):
        base, whole = BAND * band, float(arity**BAND)
        if band:
            last = F.ceil(F.col("n") / F.lit(float(arity**base))).cast("long") - 1
            nodes = sizes.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("index"))
        else:
            nodes = leaves
        nodes = nodes.withColumn("block", F.floor(F.col("index") / whole).cast("long"))
        here = links.where((F.col("level") > base) & (F.col("level") <= base + BAND))
        down = F.pow(F.lit(float(arity)), F.lit(base + BAND) - F.col("level"))
        here = here.select("tree", F.floor(F.col("index") / down).cast("long").alias("block"), "level", "index", "digest")
        here = here.unionByName(above.select("tree", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("index"), "digest"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.drop("block").schema) + ", path binary"
        out = nodes.groupBy("tree", "block").cogroup(here.groupBy("tree", "block")).applyInPandas(_only_nodes(_paths(base, arity), nodes.drop("block").columns), schema)
        if band:
            above = cut(out.select("tree", F.col("index").alias("block"), F.col("path").alias("digest")), "paths")
    return out


def _only_nodes(paths, columns: list[str]):
    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return paths(nodes, links)[[*columns, "path"]]

    return run


@dataclass
class Manifest:
    """``leaves(tree, index, n, id, digest, ..)``, ``links`` and ``trees(tree, n, digest)`` with those over the trees, and the root's digest (null for an empty table)."""

    leaves: DataFrame
    links: DataFrame
    trees: DataFrame
    top_links: DataFrame
    root: bytes | None
    arity: int
    largest: int

    def proofs(self) -> DataFrame:
        """The leaves with ``subroot``, their tree's root, and ``path``: for each level from below the own place, the number of siblings and their digests."""
        n = self.trees.count()
        nowhere = self.trees.select(F.lit("").alias("tree"), F.lit(b"").alias("digest")).where(F.lit(False))
        one = self.trees.agg(F.lit("").alias("tree"), F.count("*").alias("n"))
        tops = _descend(self.trees.select(F.lit("").alias("tree"), "index", F.col("tree").alias("key")), self.top_links, nowhere, one, self.arity, n)
        tops = cut(tops.select(F.col("key").alias("tree"), F.col("path").alias("digest")), "tops")
        return _descend(self.leaves, self.links, tops, self.trees, self.arity, self.largest)


def tree_of(column: Column) -> Column:
    """A group's key: its name after a mark, so that keys sort as the names do, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def manifest(rows: DataFrame, arity: int = ARITY, subtree: int = SUBTREE) -> Manifest:
    """The manifest of ``rows(tree, id, digest, ..)``: ``tree`` is the group's key, ``digest`` 32 bytes.

    Leaves of a group ascend by id, null ids last, then by digest; rows alike in both are
    interchangeable. A group of one row has that leaf as root, a manifest of one group that
    group's root. Other columns are carried along. An empty table has no trees and no root.
    """
    ranked = with_rank(rows.withColumn("tie", F.monotonically_increasing_id()), ["tree", F.col("id").asc_nulls_last(), "digest", "tie"], "place").drop("tie")
    trees = ranked.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    trees = cut(with_rank(trees, ["tree"], "index").withColumn("index", F.col("index") - 1), "trees")
    leaves = cut(join_hot(ranked, trees.select("tree", "first", "n"), ["tree"], "n").withColumn("index", F.col("place") - F.col("first")).drop("place", "first"), "leaves")
    largest, groups = trees.agg(F.max("n"), F.count("*")).first()
    done = _climb(leaves.select("tree", F.col("n").alias("size"), F.lit(0).alias("level"), "index", "digest"), arity, largest or 0, subtree)
    links = done.where("done = 1").select("tree", "level", "index", "digest")
    roots = done.where("done = 2").select("tree", F.col("digest"))
    trees = cut(trees.select("tree", "n", "index").join(roots, "tree"), "subroots")
    over = _climb(trees.select(F.lit("").alias("tree"), F.lit(groups).cast("long").alias("size"), F.lit(0).alias("level"), "index", "digest"), arity, groups)
    root = over.where("done = 2").select("digest").first()
    return Manifest(leaves, links, trees, over.where("done = 1").select("tree", "level", "index", "digest"), bytes(root[0]) if root else None, arity, largest or 1)


def field_bytes(column: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its UTF-8 size, a colon, the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_bytes(c) for c in columns]), 256))


def _checked(root: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaves, seen, subroots, paths = (batch.column(k) for k in range(5))
            out = [(folded(s, p), proof_digest(p)) for s, p in zip(seen.to_pylist(), paths.to_pylist(), strict=True)]
            hexes = lambda values: pa.array([v.hex() for v in values], pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, hexes(leaves.to_pylist()), hexes(subroots.to_pylist()), hexes([root] * len(out)), hexes(p for _, p in out), hexes(f for f, _ in out), pa.array([f == root for f, _ in out], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )
        release()

    return run


def verified_documents(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Every row's leaf, proof and verification against a second reading of the row, which is tampered with for a third of all ids.

    A row is hashed over doc_id, source, lang, n_chars and text; a tree holds a language, null the
    first. The tampering lower-cases A-Z of the text where the id's crc32 is a multiple of 3; null
    ids and null texts are left alone. Repeated rows are leaves of their own; other columns are
    left out; an empty table gives an empty one.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.col("n_chars").cast("long").alias("n_chars"))
    leaf = lambda text: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & F.col("text").rlike("[A-Z]")
    rows = cut(own.select(tree_of(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"), leaf(F.col("text")).alias("digest"), F.when(hit, leaf(lower)).alias("tampered")), "hashed")
    found = manifest(rows, arity)
    drop(rows)
    proofs = join_hot(found.proofs(), found.trees.select("tree", F.col("digest").alias("subroot"), F.col("n").alias("rows")), ["tree"], "rows")
    seen = proofs.select("id", "digest", F.coalesce("tampered", "digest").alias("seen"), "subroot", "path")
    return seen.mapInArrow(_checked(found.root), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Levels of the trees that the SQL below can hold: 8 to that power leaves.
_SQL_LEVELS = 7


def _sql() -> str:
    """The same rows with a run of siblings as a list and one step a level."""
    size = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(size(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
    steps = [
        f"l0 AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, leaf, CASE WHEN crc % 3 = 0 THEN {leaf('low')} ELSE leaf END AS seen FROM (SELECT *, {leaf('text')} AS leaf, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, {crc} AS crc FROM documents))",
        "n0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l0)",
        "p0 AS (SELECT doc_id, lang, i, leaf, seen, '' AS proof FROM l0)",
    ]
    for k in range(_SQL_LEVELS):
        steps += [
            f"r{k} AS (SELECT lang, i // 8 AS up, list(h ORDER BY i) AS run, any_value(n) AS n FROM n{k} GROUP BY lang, i // 8)",
            f"n{k + 1} AS (SELECT lang, up AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, count(*) OVER (PARTITION BY lang) AS n FROM r{k})",
            f"p{k + 1} AS (SELECT doc_id, p.lang, i // 8 AS i, leaf, CASE WHEN n > 1 THEN sha256(array_to_string(run[1:i % 8], '') || seen || array_to_string(run[i % 8 + 2:], '')) ELSE seen END AS seen, CASE WHEN n > 1 THEN proof || array_to_string(run[1:i % 8], '') || array_to_string(run[i % 8 + 2:], '') ELSE proof END AS proof FROM p{k} p JOIN r{k} r ON p.lang IS NOT DISTINCT FROM r.lang AND p.i // 8 = r.up)",
        ]
    a, b = _SQL_LEVELS, _SQL_LEVELS + 1
    steps += [
        f"s AS (SELECT lang, h AS subroot FROM n{a})",
        f"n{b} AS (SELECT lang AS tree, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM n{a})",
        f"p{b} AS (SELECT p.doc_id, p.lang, t.i, leaf, seen, proof FROM p{a} p JOIN n{b} t ON p.lang IS NOT DISTINCT FROM t.tree)",
    ]
    for k in range(b, b + 3):
        steps += [
            f"r{k} AS (SELECT i // 8 AS up, list(h ORDER BY i) AS run, any_value(n) AS n FROM n{k} GROUP BY i // 8)",
            f"n{k + 1} AS (SELECT up AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, count(*) OVER () AS n FROM r{k})",
            f"p{k + 1} AS (SELECT doc_id, lang, i // 8 AS i, leaf, CASE WHEN n > 1 THEN sha256(array_to_string(run[1:i % 8], '') || seen || array_to_string(run[i % 8 + 2:], '')) ELSE seen END AS seen, CASE WHEN n > 1 THEN proof || array_to_string(run[1:i % 8], '') || array_to_string(run[i % 8 + 2:], '') ELSE proof END AS proof FROM p{k} p JOIN r{k} r ON i // 8 = r.up)",
        ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = h AS verified FROM p{b + 3} p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang, n{b + 3}"


OP13_SQL = _sql()

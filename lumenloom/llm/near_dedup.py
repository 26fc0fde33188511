"""Near duplicates: fast similarity sketches, banding, and exact verification on full sets.

Rows with equal shingle sets are one class, a node of its own whatever ids its rows have. Classes
meet in buckets of equal band keys; buckets with the same members are one. What buckets tie
together, directly or not, is a cluster. A cluster that fits into a block is one group of rows:
each of its texts is dealt once, and all are compared with all. Larger clusters go by buckets, and within a bucket no
list of pairs is made: first every member is compared with the bucket's least member, which joins
most large groups; then, with the components known, the members outside a bucket's largest
component are compared with the others. Both happen in blocks of texts, whose sets are multiplied
as matrices; a large bucket is many blocks, dealt one by one. Pairs within one component can add
nothing, so no link that could change a component is left out, however large a bucket is. Texts
are shuffled, compressed, and not their sets, which are larger and are made again from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.llm.bytewords import SLICE_BYTES, slices
from lumenloom.llm.hot import LEAST, MOST, bounded, join_hot, release
from lumenloom.operators.graph import components
from lumenloom.scratch import cut, drop

SIMILARITY_PERCENT = 80
#: 30 bands of 5 coordinates: a pair at 0.8 shares no band with probability (1 - 0.8^5)^30, 7 in a million.
BANDS, ROWS = 30, 5
#: Ids of eight bytes that are broadcast to filter rows; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Sets and shingles that a block should hold at most, and shingles in a piece of a block's matrix.
BLOCK, BLOCK_SHINGLES, _COLUMNS = 128, 500_000, 4096


def _signatures(size: int, bands: int, rows: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenloom.llm import sketching as S

        for batch in batches:
            for part in slices(batch.column(2), slice_bytes):
                values, begin = S.shingle_sets(part, size)
                n = np.diff(begin)
                keys = S.band_keys(S.sketches(values, begin, bands * rows), bands, rows)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].reshape(-1).view(np.int64)))
                d = [pa.array(S.set_digest(values, begin, s).view(np.int64)) for s in (11, 12)]
                own = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array(n.astype(np.int64)), *d, listed], ["row", "doc_id", "n", "d1", "d2", "keys"])
        release()

    return run


def _power(x: Column) -> Column:
    """The least power of two that is not below x, at least 1."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), x.cast("double"))))).cast("long")


def _blocks(members: Column, shingles: Column) -> Column:
    return _power(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES))


def _part(node: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(seed)), blocks)


def _signed(rows: DataFrame, text: str, shingle: int, bands: int, per_band: int, slice_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``rows`` with ``row``, a number of its own, and by that number ``doc_id``, set size, digests and band keys."""
    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    read = numbered.select("row", "doc_id", F.col(f"`{text}`"))
    return numbered, cut(read.mapInArrow(_signatures(shingle, bands, per_band, slice_bytes), "row long, doc_id long, n long, d1 long, d2 long, keys array<bigint>"), "signed")


def _met(members: DataFrame) -> DataFrame:
    """``members(key, node, n)``, read from written tables, of the buckets that more than one node has, with their bucket's least member ``center``, size ``c`` and two checksums of its members.

    Most keys are one node's alone, so rows are dealt by key once, as narrow as they are, and what
    has met nobody goes no further. Rows of hot keys are reduced in their tasks instead. A share
    of the nodes tells which keys are hot; that decides how a bucket is put together and not what is in it.
    """
    about = {"center": F.min(F.struct("node", "n")), "c": F.count("*"), **{f"x{k}": F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)}}
    limit = max(LEAST, members.count() // MOST)
    share = 1 << max(0, (limit // 16).bit_length() - 1)  # 16 to 32 rows of a key with ``limit`` rows are looked at
    seen = members.where(F.pmod(F.xxhash64("node", F.lit(8)), F.lit(share)) == 0)
    hot = cut(seen.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= limit // share // 2).select("key"), "hot")
    whole = Window.partitionBy("key")
    dealt = members.join(F.broadcast(hot), "key", "left_anti").repartition("key")  # before the window, which would deal out what it looks at as well
    cold = dealt.withColumns({k: x.over(whole) for k, x in about.items()})
    rows = members.join(F.broadcast(hot), "key", "left_semi")
    found = cut(rows.groupBy("key").agg(*[x.alias(k) for k, x in about.items()]), "found")  # as many rows as hot keys
    return cold.unionByName(rows.join(F.broadcast(found), "key")).where("c > 1")


def _hinted(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _clusters(shared: DataFrame) -> DataFrame:
    """``node, cluster`` of all members, a written table: a cluster is what buckets tie together; null if it is too large for one block."""
    tied = components(shared.select(F.col("center.node").alias("u"), F.col("node").alias("v")))
    own = shared.select("node", "n").distinct().join(tied, "node", "left")
    own = cut(own.select("node", "n", F.coalesce("label", "node").alias("label")), "tied")
    sums = cut(own.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s")), "clusters")
    small = (F.col("c") <= BLOCK) & (F.col("s") <= BLOCK_SHINGLES)
    out = cut(join_hot(own, sums, ["label"], "c").select("node", F.when(small, F.col("label")).alias("cluster")), "candidates")
    drop(tied, own, sums)
    return out


def _labels(shared: DataFrame, texts: DataFrame, shingle: int, percent: int, slice_bytes: int) -> DataFrame:
    """``node, label`` of each member that is not itself the least of its component, a written table. ``texts(node, cluster, text)``."""
    dealt = texts.where("cluster IS NOT NULL").select("cluster", "node", "text").repartition("cluster").sortWithinPartitions("cluster", "node")
    labels = cut(dealt.mapInArrow(_compare_cluster(shingle, percent, slice_bytes), "node long, label long"), "labels")
    large = cut(texts.where("cluster IS NULL").select("node", "text"), "texts")
    if large.isEmpty():
        drop(large)
        return labels
    # a bucket is in one cluster as a whole
    own = cut(shared.join(large.select("node"), "node", "left_semi"), "shared")
    links = cut(_star_links(own, large, shingle, percent, slice_bytes), "links")
    found = components(links)
    more = cut(_crossing(own, found, large, shingle, percent, slice_bytes), "links")
    if not more.isEmpty():
        # each node's tie to its component says what the links said, in one step
        old, found = found, components(found.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))
        drop(old)
    out = cut(labels.unionByName(found), "labels")
    drop(large, own, links, more, labels, found)
    return out


def _named(numbered: DataFrame, signed: DataFrame, shingle: int, percent: int, text: str, slice_bytes: int) -> DataFrame:
    """``row, doc_id, n, best`` of all rows: ``best`` is the row that stands for the row's component, null for empty sets.

    A component's best row is that with the smallest id, null ids last, and of those the first as
    written. The tables are those of ``_signed``.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    filled = signed.where("n > 0")
    classes = cut(filled.groupBy("n", "d1", "d2").agg(F.min("row").alias("node"), best, F.count("*").alias("rows")), "classes")
    # a class' other rows are left out; they are looked for by digests, so that band keys stay where they are
    copies = join_hot(signed.select("row", "n", "d1", "d2"), classes.where("rows > 1").select("n", "d1", "d2", "node", "rows"), ["n", "d1", "d2"], "rows")
    copies = cut(copies.where("row <> node").select("row"), "copies")
    members = filled.join(_hinted(copies), "row", "left_anti").select(F.col("row").alias("node"), "n", F.explode("keys").alias("key"))
    if copies.count() > BROADCAST_IDS:  # that join deals out all rows, which shouldn't be done for each reading
        members = cut(members, "members")
    met = cut(_met(members), "met")
    drop(members, copies)
    # a bucket's center is in it, so there is one such row a bucket
    buckets = met.where(F.col("node") == F.col("center.node")).groupBy("center", "c", "x1", "x2").agg(F.min("key").alias("key")).select("key", "center", "c")
    buckets = cut(buckets, "buckets")
    shared = cut(join_hot(met.select("key", "node", "n"), buckets, ["key"], "c"), "shared")
    drop(met, buckets)
    ids = _clusters(shared)
    texts = numbered.select(F.col("row").alias("node"), F.col(f"`{text}`").alias("text")).join(_hinted(ids), "node")
    texts = cut(texts.select("node", "cluster", "text"), "texts")
    labels = _labels(shared, texts, shingle, percent, slice_bytes)
    drop(shared, ids, texts)
    # class to component, component to its best row: both from tables of one row a class
    owned = cut(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "owned")
    bests = cut(owned.groupBy("label").agg(F.min("best").alias("best"), F.count("*").alias("c")), "bests")
    found = cut(join_hot(owned.select("n", "d1", "d2", "rows", "label"), bests, ["label"], "c").select("n", "d1", "d2", "rows", "best"), "found")
    out = join_hot(signed.select("row", "doc_id", "n", "d1", "d2"), found, ["n", "d1", "d2"], "rows", "left").select("row", "doc_id", "n", "best")
    out = cut(out, "named")
    drop(classes, labels, owned, bests, found)
    return out


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = SIMILARITY_PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every row's component: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when their sets of ``shingle`` words, with A-Z in lower case, have a Jaccard
    similarity of ``percent`` hundredths or more; shingles are told apart by 64-bit hashes and
    sets by 128-bit digests. Null texts and texts without words have an empty set and are linked
    with nothing. A component's id is the smallest that any of its rows has, null if none has
    one; different texts under one id are texts of their own. ``kept`` tells whether a row has
    its component's id. Other columns are left out; an empty table gives an empty one.
    """
    bounded(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    numbered, signed = _signed(texts, "text", shingle, bands, rows, slice_bytes)
    out = _named(numbered, signed, shingle, percent, "text", slice_bytes)
    drop(numbered, signed)
    component = F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = 5, percent: int = SIMILARITY_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    Rows are told apart by their place in a written table and not by their ids: of a component the
    row with the smallest id stays, null ids last, of equal ids the first as read. Texts under one
    id that are not alike are all kept, rows that are alike and have no id leave one. Rows without
    words all stay. Columns may have any names; an empty table gives an empty one.
    """
    bounded(docs.sparkSession)
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    ident, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = own.withColumns({"doc_id": F.col(ident).cast("long"), "__lm_text": F.col(text).cast("string")}) if docs.schema[text_col].dataType.typeName() != "string" else own.withColumn("doc_id", F.col(ident).cast("long"))
    read = "__lm_text" if "__lm_text" in rows.columns else text
    numbered, signed = _signed(rows, read, shingle, BANDS, ROWS, SLICE_BYTES)
    found = _named(numbered, signed, shingle, percent, read, SLICE_BYTES)
    gone = cut(found.where(F.col("n") > 0).where(F.col("row") != F.col("best.row")).select("row"), "gone")
    drop(found, signed)
    return numbered.join(_hinted(gone), "row", "left_anti").select(*names).toDF(*docs.columns)


def common_sizes(sizes: np.ndarray, values: np.ndarray, other_sizes: np.ndarray, other_values: np.ndarray) -> np.ndarray:
    """Of each set with each other set the size of what they have in common: a product of two 0/1 matrices, by columns of shingles that both sides have."""
    shared = np.intersect1d(values, other_values)
    out = np.zeros((len(sizes), len(other_sizes)), np.float32)

    def placed(sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(shared, values)
        ok = col < len(shared)
        ok[ok] = shared[col[ok]] == values[ok]
        order = np.argsort(col[ok], kind="stable")
        return row[ok][order], col[ok][order]

    (ra, ca), (rb, cb) = placed(sizes, values), placed(other_sizes, other_values)
    for start in range(0, len(shared), _COLUMNS):
        parts = []
        for n, r, c in ((len(sizes), ra, ca), (len(other_sizes), rb, cb)):
            i, j = np.searchsorted(c, [start, start + _COLUMNS])
            dense = np.zeros((n, min(_COLUMNS, len(shared) - start)), np.float32)
            dense[r[i:j], c[i:j] - start] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


class _Sets:
    """Shingle sets of some texts, made as they are needed; those of the last texts are kept."""

    def __init__(self, size: int, slice_bytes: int):
        self.size, self.slice_bytes = size, slice_bytes

    def of(self, column: pa.Array) -> list[np.ndarray]:
        from lumenloom.llm import sketching as S

        out = []
        for part in slices(column, self.slice_bytes):
            values, begin = S.shingle_sets(part, self.size)
            out += [values[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        return out


def _alike(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    s, t = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    common = common_sizes(s, np.concatenate(a), t, np.concatenate(b))
    return 100 * common >= percent * (s[:, None] + t[None, :] - common)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, size: int, slice_bytes: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Runs of rows with the same first ``n_keys`` columns (rows come sorted by them): the other columns, ``text`` last, and the texts' sets."""
    sets, held, key = _Sets(size, slice_bytes), [], None

    def flush():
        columns = [np.concatenate([h[0][k] for h in held]) for k in range(len(held[0][0]))]
        return columns, [s for h in held for s in h[1]]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)])
        edges = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), batch.num_rows)
        own = sets.of(batch.column(batch.num_columns - 1))
        others = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys, batch.num_columns - 1)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            now = tuple(keys[:, a].tolist())
            if key is not None and now != key:
                yield flush()
                held = []
            key = now
            held.append(([c[a:b] for c in others], own[a:b]))
    if held:
        yield flush()


def _links(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        u, v = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _compare_cluster(size: int, percent: int, slice_bytes: int):
    """Each member that is linked, over others if need be, with a lesser one: it and the least. Members come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (node,), sets in _groups(batches, 1, size, slice_bytes):
            linked = _alike(sets, sets, percent)
            label, last = np.arange(len(sets)), None
            while last is None or (label != last).any():
                last, label = label, np.where(linked, label, len(sets)).min(axis=1)
            other = label != np.arange(len(sets))
            found.append(np.stack([node[other], node[label[other]]]))
        if found:
            node, label = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])
        release()

    return run


def _compare_star(size: int, percent: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (center, node), sets in _groups_with(batches, 3, size, slice_bytes):
            at = int(np.flatnonzero(node == center)[0])
            ok = _alike([sets[at]], sets, percent)[0]
            ok[at] = False
            found.append(np.stack([center[ok], node[ok]]))
        yield from _links(found)
        release()

    return run


def _groups_with(batches: Iterator[pa.RecordBatch], n_keys: int, size: int, slice_bytes: int):
    """``_groups`` of batches whose first column is both a key and wanted."""

    def doubled():
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], b.column(0), *b.columns[n_keys:]], [f"k{k}" for k in range(n_keys)] + ["first", *b.schema.names[n_keys:]])

    return _groups(doubled(), n_keys, size, slice_bytes)


def _star_links(shared: DataFrame, texts: DataFrame, size: int, percent: int, slice_bytes: int) -> DataFrame:
    """Links of bucket members with their bucket's least member, in blocks that hold that member and some others.

    Sets whose sizes alone rule a link out are not compared. How many blocks a centre has follows
    from its largest bucket, so that needs no counting; a centre's text goes to each of its blocks.
    """
    fits = (100 * F.least("n", "center.n")) >= (percent * F.greatest("n", "center.n"))
    pairs = shared.where(F.col("node") != F.col("center.node")).where(fits)
    pairs = pairs.groupBy(F.col("center.node").alias("center"), "node").agg(F.max("c").alias("c"), F.max("center.n").alias("n"))
    blocks = _blocks(F.col("c"), F.col("c") * F.col("n"))
    pairs = cut(pairs.select("center", "node", blocks.alias("blocks")).withColumn("part", _part(F.col("node"), F.col("blocks"), 5)), "stars")
    centers = pairs.select("center", "blocks", "part", F.col("center").alias("node")).distinct()
    rows = pairs.select("center", "blocks", "part", "node").unionByName(centers).join(texts, "node")
    dealt = rows.select("center", "blocks", "part", "node", "text").repartition("center", "blocks", "part").sortWithinPartitions("center", "blocks", "part")
    return dealt.mapInArrow(_compare_star(size, percent, slice_bytes), "u long, v long").distinct()


def _compare_block(size: int, percent: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (node, label, few, every), sets in _groups(batches, 3, size, slice_bytes):
            a, b = np.flatnonzero(few), np.flatnonzero(every)
            if len(a) and len(b):
                ok = _alike([sets[k] for k in a], [sets[k] for k in b], percent) & (label[a][:, None] != label[b][None, :])
                i, j = np.nonzero(ok)
                u, v = node[a][i], node[b][j]
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v)]))
        yield from _links(found)
        release()

    return run


def _crossing(shared: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int, slice_bytes: int) -> DataFrame:
    """Links between members of one bucket that are in different components.

    Its least member was compared with all others and is left out. A bucket's members outside its largest component, in i blocks, are compared with all of its
    members, in j blocks: i times j independent groups of rows, each of two blocks at most. Pairs
    are not made into rows.
    """
    label = labels.withColumnRenamed("node", "l_node")
    others = shared.where("c > 2").where(F.col("node") != F.col("center.node"))
    many = others.join(label, F.col("node") == F.col("l_node"), "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    many = cut(many, "many")
    parts = many.groupBy("key", "label").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    heads = parts.groupBy("key").agg(F.max(F.struct("k", "label", "s")).alias("head"), F.sum("k").alias("c"), F.sum("s").alias("s"), F.count("*").alias("parts"))
    few = _blocks(F.col("c") - F.col("head.k"), F.col("s") - F.col("head.s"))
    heads = cut(heads.select("key", F.col("head.label").alias("head"), "c", "parts", few.alias("few_blocks"), _blocks(F.col("c"), F.col("s")).alias("blocks")), "heads")
    opened = join_hot(many, heads, ["key"], "c").where("parts > 1")
    opened = opened.withColumns({"i": _part(F.col("node"), F.col("few_blocks"), 6), "j": _part(F.col("node"), F.col("blocks"), 7), "outside": F.col("label") != F.col("head")})
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda i, j, few, every: F.struct(i.alias("i"), j.alias("j"), few.alias("few"), every.alias("every"))
    as_few = F.transform(upto("blocks"), lambda j: place(F.col("i"), j, F.lit(True), j == F.col("j")))
    as_every = F.transform(upto("few_blocks"), lambda i: place(i, F.col("j"), F.lit(False), F.lit(True)))
    both = F.concat(as_few, F.filter(as_every, lambda x: x["i"] != F.col("i")))
    rows = opened.select("key", "node", "label", F.explode(F.when(F.col("outside"), both).otherwise(as_every)).alias("x"))
    rows = rows.select("key", "x.i", "x.j", "node", "label", "x.few", "x.every").join(texts, "node")
    dealt = rows.select("key", "i", "j", "node", "label", "few", "every", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compare_block(size, percent, slice_bytes), "u long, v long").distinct()


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)

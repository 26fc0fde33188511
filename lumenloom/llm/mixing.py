"""Sources mixed to target weights: capped water-filling, then seeded repetitions.

The budget is shared by weight; a source whose share would go beyond its cap (its size times the
most epochs) is clamped there, and what it leaves is shared among the others by weight, until no
share is above its cap. A source then takes all of its documents as many whole times as its
target holds its size, and the fraction that is left as the first documents in a seeded order.
Where that order reaches the target is found by sums over 256 ranges of the order's hash, then
over the 256 ranges within the range found, and only what lies in one of those is sorted: no
source is ever sorted or summed up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.operators.ranks import with_rank
from lumenloom.scratch import cut

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = 20240

_P = "__lm_"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    trim = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trim == "", F.lit(0)).otherwise(F.regexp_count(trim, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def water_fill(sources: DataFrame, budget: float) -> DataFrame:
    """``sources(.., weight, cap)`` with ``target``. Each round clamps what is above its cap; only two sums of a round come to the driver."""
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        free, taken, n = sources.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, F.col("cap"))), F.count_if(over)).first()
        if n == clamped or not free:
            break
        level, clamped = (budget - (taken or 0)) / free, n
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)))


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, epochs: int) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``. Sources by code point, null last, have the weights in turn."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = with_rank(own, [F.col("source").asc_nulls_last()], _P + "turn")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col(_P + "turn") - 1) % len(weights) + 1).cast("int"))
    own = cut(own.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * epochs).alias("cap")), "sources")
    total = own.agg(F.sum("source_size")).first()[0] or 0
    return water_fill(own, percent * total / 100).select("source", "source_size", "target")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _reached(rows: DataFrame, bucket: str, need: str, keys: list[str]) -> DataFrame:
    """By ``keys`` the first bucket at which the running sum of sizes reaches ``need``, and the sum before it. At most 256 buckets a key."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum("size").alias("size"), F.first(need).alias(need))
    w = Window.partitionBy(*keys).orderBy(bucket)
    run = sums.withColumn("upto", F.sum("size").over(w))
    hit = run.where((F.col("upto") >= F.col(need)) & (F.col("upto") - F.col("size") < F.col(need)))
    return hit.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(bucket).alias(f"r_{bucket}"), (F.col("upto") - F.col("size")).alias("before"))


def mixed(rows: DataFrame, plan: DataFrame, sums: DataFrame | None = None, size: Column | None = None) -> DataFrame:
    """``rows(key, source, size, ..)`` with ``source_size, target, taken``.

    ``key`` is 16 hex digits or more, the seeded order. A source's fraction is its target less
    its whole epochs, rounded to words; documents take it in the order of their keys, each up to
    its size, so a source takes exactly its rounded target. Wide rows that aren't written with
    their sizes: ``sums(key, source, size)`` has them narrow, four digits of a key suffice there, and ``size`` is
    worked out once for each row.
    """
    plan = plan.withColumns({"epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")})
    plan = plan.withColumn("need", (F.round("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumnRenamed("source", "p_source")
    hexa = lambda a: F.conv(F.substring("key", a, 2), 16, 10).cast("int")
    begun = lambda of: of.withColumns({"b1": hexa(1), "b2": hexa(3)}).join(plan, _same("source", "p_source"), "left").drop("p_source")
    narrow = begun(rows if sums is None else sums)
    one = cut(_reached(narrow, "b1", "need", ["source"]), "reached").withColumnRenamed("before", "before1")
    first = lambda of: of.join(one, _same("source", "r_source"), "left").drop("r_source").withColumnRenamed("r_b1", "t1")
    inner = first(narrow).where(F.col("b1") == F.col("t1")).withColumn("need2", F.col("need") - F.col("before1"))
    two = cut(_reached(inner, "b2", "need2", ["source"]), "reached").withColumnRenamed("before", "before2")
    out = first(begun(rows)).join(two, _same("source", "r_source"), "left").drop("r_source").withColumnRenamed("r_b2", "t2")
    last = (F.col("b1") == F.col("t1")) & (F.col("b2") == F.col("t2"))
    sized = lambda of: of if size is None else of.withColumn("size", size)
    edge = sized(out.where(last))
    w = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("need") - F.col("before1") - F.col("before2") - F.coalesce(F.sum("size").over(w), F.lit(0))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    early = (F.col("b1") < F.col("t1")) | ((F.col("b1") == F.col("t1")) & (F.col("b2") < F.col("t2")))
    rest = sized(out.where(~F.coalesce(last, F.lit(False)))).withColumn("part", F.when(early, F.col("size")).otherwise(F.lit(0)))
    return edge.unionByName(rest).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def order_key(seed: int, *columns: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    Size is the number of words; null and empty texts have none and take none. Null sources are
    one source, the last. The order depends on the seed and the id, so reruns agree; rows with the
    same id and size are interchangeable. Other columns are left out; an empty table gives an
    empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = cut(rows.withColumn("key", order_key(seed, F.col("doc_id"))), "sizes")
    return mixed(rows, cut(targets(rows, weights, percent, epochs), "targets")).select("doc_id", "size", "source_size", "target", "taken")


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken whole, and a last time cut after the words that are left (at most one such row a source).

    ``docs`` is read for the sizes and again for the rows, which are not written in between: it should be a table.
    """
    names = docs.columns
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"))
    rows = packed.withColumn("key", order_key(seed, F.col("doc_id")))
    size = word_count(F.col(f"row.c{names.index('text')}"))
    sums = cut(rows.select("source", size.alias("size"), F.substring("key", 1, 4).alias("key")), "sizes")
    out = mixed(rows, cut(targets(sums.select("source", "size"), weights, percent, epochs), "targets"), sums, size)
    out = out.withColumn("times", F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0))).withColumn("over", F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("times").cast("int")), F.when(F.col("over") > 0, F.array("over")).otherwise(F.array().cast("array<bigint>")))
    out = out.select("row", F.explode(copies).alias("words"))
    cut_text = lambda c: F.when(F.col("words") < 0, c).otherwise(F.array_join(F.slice(F.split(F.btrim(c, F.lit(" \t\n\x0b\x0c\r")), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("words").cast("int")), ""))
    return out.select(*[(cut_text(F.col(f"row.c{k}")) if c == "text" else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(names)])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('20240/' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
b AS (SELECT *, 2 * source_size AS cap, 150 * sum(source_size) OVER () / 100 AS budget FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY cap / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM b),
lv AS (SELECT arg_min((budget - below) / open, cap / w) AS level FROM r WHERE (budget - below) / open * w <= cap),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * level) AS target FROM r, lv),
x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CAST(round(target) AS BIGINT) - epochs * source_size - coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM x)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM y
"""

"""Quality rules with thresholds that follow each language and source.

Everything here is DataFrame functions. The quantile sketch is a histogram with log-linear
buckets: values below 128 have a bucket each, larger ones keep their seven leading bits, so a
quantile is off by less than one part in 64. Sketches are counts per bucket, so they merge by
adding, within a task, over tasks, and from sources to languages to the whole corpus, and the
result never depends on the order of merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.scratch import cut

BLANKS = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A group's fence counts as if it had been seen on as many documents as it has, and its parent's (the
#: language of a source, the corpus of a language) on so many more: small groups lean on their parent.
PRIOR = 100
#: A document is rejected where a ratio lies above the third quartile by more than REACH times the distance
#: of the quartiles, and by more than the figure given here for the ratio (in thousandths; word length in
#: hundredths of a code point). The figures matter where three quarters of a group have the same value, as
#: of symbols, repeated lines and repeated windows, which most texts don't have at all: quartiles say nothing there.
REACH = 8
LEAST_DISTANCE = {"symbols": 60, "dup_lines": 450, "repeats": 300, "capitals": 10, "word_length": 10}

_P = "__lm_"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with measures of the whole text in columns ``__lm_*``; null text has no word."""
    c = lambda name: F.col(_P + name)
    trim = F.btrim(c("text"), F.lit(" \t\n\x0b\x0c\r"))
    out = docs.withColumn(_P + "text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    out = out.withColumn(_P + "words", F.when(trim == "", F.array().cast("array<string>")).otherwise(F.split(trim, BLANKS)))
    lines = F.filter(F.split(c("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns(
        {
            _P + "lines": lines,
            _P + "signs": F.regexp_replace(c("text"), r"[^#*$%&|<>A-Z]+", ""),
            _P + "n_words": F.size(c("words")).cast("long"),
            _P + "windows": F.when(F.size(c("words")) > 2, F.transform(F.sequence(F.lit(0), F.size(c("words")) - 3), lambda i: F.xxhash64(F.get(c("words"), i), F.get(c("words"), i + 1), F.get(c("words"), i + 2)))).otherwise(F.array().cast("array<bigint>")),
        }
    )
    out = out.withColumns(
        {
            _P + "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
            _P + "n_lines": F.size(c("lines")).cast("long"),
            _P + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            _P + "n_symbols": F.length(F.regexp_replace(c("signs"), "[A-Z]+", "")).cast("long"),
            _P + "n_capitals": F.length(F.regexp_replace(c("signs"), "[^A-Z]+", "")).cast("long"),
            # only texts in which a window occurs again are sorted
            _P + "sorted": F.when(F.size(F.array_distinct(c("windows"))) < F.size(c("windows")), F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        }
    )
    again = F.filter(c("sorted"), lambda x, k: (x["h"] == F.get(c("sorted"), k + 1)["h"]) | (x["h"] == F.get(c("sorted"), k - 1)["h"]))
    out = out.withColumn(_P + "again", F.when(c("sorted").isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))))
    covered = F.aggregate(
        c("again"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    out = out.withColumn(_P + "n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return out.drop(*[_P + x for x in ("words", "lines", "signs", "windows", "sorted", "again", "text")])


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def base_failed() -> Column:
    n, r = F.col(_P + "n_words"), F.col(_P + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def ratios() -> dict[str, Column]:
    """Whole-number ratios; 0 where there is nothing to divide by."""
    c = lambda name: F.col(_P + name)
    part = lambda a, b, k=1000: F.when(c(b) > 0, F.expr(f"{k} * {_P}{a} div {_P}{b}")).otherwise(F.lit(0).cast("long"))
    return {
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "capitals": part("n_capitals", "word_chars"),
        "word_length": part("word_chars", "n_words", 100),
    }


def bucket(x: Column) -> Column:
    shift = (F.length(F.bin(x)) - 7).cast("int")
    return F.when(x < 128, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift))


def sketch(measures: DataFrame) -> DataFrame:
    """Counts by language, source, ratio and bucket, over documents that pass the base rules."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), bucket(v).alias("bucket")) for k, v in ratios().items()])
    rows = measures.where(~base_failed()).select("lang", "source", F.explode(kinds).alias("x"))
    return rows.groupBy("lang", "source", F.col("x.kind").alias("kind"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def fences(counts: DataFrame) -> DataFrame:
    """Upper fences of every language and source of a sketch, from its own, its language's and all counts."""
    from pyspark.sql import Window

    merged = counts.selectExpr("lang", "source", "2 as level", "kind", "bucket", "n")
    for level, lang in ((1, "lang"), (0, "cast(null as string)")):
        merged = merged.unionByName(counts.groupBy(F.expr(lang).alias("lang"), "kind", "bucket").agg(F.sum("n").alias("n")).selectExpr("lang", "cast(null as string) as source", f"{level} as level", "kind", "bucket", "n"))
    group = Window.partitionBy("level", "lang", "source", "kind")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    by_kind = ranked.groupBy("level", "lang", "source", "kind").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    least = F.create_map(*[F.lit(x) for kv in LEAST_DISTANCE.items() for x in kv])
    fence = (F.col("q3") + F.greatest(REACH * (F.col("q3") - F.col("q1")), least[F.col("kind")].cast("long"))).cast("double")
    wide = by_kind.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[F.max(F.when(F.col("kind") == k, fence)).alias(f"{_P}max_{k}") for k in LEAST_DISTANCE])
    cols = [f"{_P}max_{k}" for k in LEAST_DISTANCE]
    level = lambda n: wide.where(F.col("level") == n).select("lang", *([] if n < 2 else ["source"]), "total", F.struct(*cols).alias(f"f{n}"))
    own = level(2).withColumnsRenamed({"total": "total2"})
    lang = level(1).withColumnsRenamed({"lang": "lang1", "total": "total1"})
    whole = level(0).drop("lang", "total")
    found = own.join(lang, F.col("lang").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(whole), how="left")  # one row
    blend = lambda n, own, parent: (F.col(n) * own + F.lit(float(PRIOR)) * parent) / (F.col(n) + F.lit(float(PRIOR)))
    one = lambda c: blend("total2", F.col(f"f2.{c}"), blend("total1", F.col(f"f1.{c}"), F.col(f"f0.{c}"))).alias(c)
    return found.select(F.col("lang").alias(_P + "lang"), F.col("source").alias(_P + "source"), *[one(c) for c in cols])


def judged(measures: DataFrame) -> DataFrame:
    """Measures (a table, read twice) with ``__lm_base_failed`` and ``__lm_kept``."""
    limits = cut(fences(sketch(measures)), "fences")  # one row a language and source; its size is known to the join
    joined = measures.join(limits, F.col("lang").eqNullSafe(F.col(_P + "lang")) & F.col("source").eqNullSafe(F.col(_P + "source")), "left")
    within = F.lit(True)
    for kind, value in ratios().items():
        within &= value <= F.coalesce(F.col(f"{_P}max_{kind}"), value)
    out = joined.withColumn(_P + "base_failed", base_failed())
    return out.withColumn(_P + "kept", ~F.col(_P + "base_failed") & within)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per document its measures, whether the base rules fail, and the verdict.

    Null languages and sources are groups of their own; a null text has no word and fails. Null
    ids stay null, repeated rows count and return as often as they occur, other columns are left
    out, an empty table gives an empty one.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(lang as string) as lang", "cast(source as string) as source", "text")
    table = cut(measured(rows).select("doc_id", "lang", "source", *[_P + m for m in MEASURES]), "measures")
    return judged(table).select("doc_id", *[F.col(_P + m).alias(m) for m in MEASURES[:5]], F.col(_P + "base_failed").alias("base_failed"), F.col(_P + "kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Only rows that pass the base rules count for the thresholds or can be kept: those are written
    once, with their measures, so no row has to be found again by its id. Null texts fail, null
    languages and sources are groups of their own, repeated rows and null ids are kept as they
    are, columns may have any names, an empty table gives an empty one.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    lang, source, text = (names[docs.columns.index(c)] for c in ("lang", "source", "text"))
    known = own.withColumns({"lang": F.col(lang).cast("string"), "source": F.col(source).cast("string")})
    # the partition's number keeps the filter above the measures: below, it would evaluate their nested expressions anew
    passing = measured(known, text).withColumn(_P + "part", F.spark_partition_id()).where((F.col(_P + "part") >= 0) & ~base_failed())
    table = cut(passing.drop(_P + "part"), "measured")
    return judged(table).where(_P + "kept").select(*names).toDF(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM p),
rep AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS r1, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS r2,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS r3, CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS r4,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS r5 FROM m),
v AS (SELECT lang, source, unnest([1, 2, 3, 4, 5]) AS kind, unnest([r1, r2, r3, r4, r5]) AS x FROM r WHERE NOT base_failed),
b AS (SELECT lang, source, kind, CASE WHEN x < 128 THEN x ELSE (x >> (length(bin(x)) - 7)) << (length(bin(x)) - 7) END AS x FROM v),
l AS (SELECT 2 AS level, lang, source, kind, x FROM b UNION ALL SELECT 1, lang, NULL, kind, x FROM b UNION ALL SELECT 0, NULL, NULL, kind, x FROM b),
c AS (SELECT level, lang, source, kind, x, count(*) AS n FROM l GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, kind ORDER BY x) AS upto, sum(n) OVER (PARTITION BY level, lang, source, kind) AS total FROM c),
q AS (SELECT level, lang, source, kind, max(total) AS total, min(x) FILTER (4 * upto >= total) AS q1, min(x) FILTER (4 * upto >= 3 * total) AS q3 FROM u GROUP BY ALL),
f AS (SELECT level, lang, source, kind, CAST(total AS DOUBLE) AS total, CAST(q3 + greatest(8 * (q3 - q1), [60, 450, 300, 10, 10][kind]) AS DOUBLE) AS fence FROM q),
t AS (SELECT f2.lang, f2.source, f2.kind, (f2.total * f2.fence + 100.0::DOUBLE * ((f1.total * f1.fence + 100.0::DOUBLE * f0.fence) / (f1.total + 100.0::DOUBLE))) / (f2.total + 100.0::DOUBLE) AS fence
  FROM f f2 JOIN f f1 ON f1.level = 1 AND f1.lang IS NOT DISTINCT FROM f2.lang AND f1.kind = f2.kind JOIN f f0 ON f0.level = 0 AND f0.kind = f2.kind WHERE f2.level = 2),
bad AS (SELECT DISTINCT rid FROM r JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source WHERE [r1, r2, r3, r4, r5][kind] > fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM r LEFT JOIN bad ON r.rid = bad.rid
"""

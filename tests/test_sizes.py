"""What a table's size must not change: nothing is cut off, tables make more pages and files and not larger ones."""

import gzip
from pathlib import Path

from pyspark.sql import functions as F

from lumenloom.plans.registry import all_queries
from lumenloom.scratch import new_path
from lumenloom.sources import m3u
from lumenloom.sources import records as R


def tables(spark, **named):
    """A folder with the given tables."""
    path = new_path(spark, "tables")
    for name, rows in named.items():
        rows.write.parquet(f"{path}/{name}.parquet")
    return path


def parts(spark, n, kind):
    columns = [F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), kind.alias("p_type"), F.lit(1).alias("p_size")]
    return spark.range(n).select(*columns)


def test_a_playlist_of_more_than_the_default_limit_comes_back_whole(spark):
    path = tables(spark, part=parts(spark, 4500, F.repeat(F.lit("x"), 4000)))
    assert 4500 * 4000 > m3u.MAX_BYTES
    back = all_queries()[0]["m3u_roundtrip"](spark, path)
    assert back.agg(F.count("*"), F.count_distinct("url")).first()[:] == (4500, 4500)


def plan(spark, name, **named):
    rows = all_queries()[0][name](spark, tables(spark, **named))
    return rows._jdf.queryExecution().optimizedPlan().toString()


def events(spark, n):
    columns = [F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props")]
    return spark.range(n).select(*columns)


def test_a_page_is_made_and_read_once_and_not_again_for_each_condition(spark):
    shown = plan(spark, "page_table_logo", part=parts(spark, 20, F.lit("t")))
    assert shown.count("chrome.png") == 1 and shown.count("RepartitionByExpression") == 1


def test_conditions_on_an_answers_slots_look_at_what_was_read(spark):
    shown = plan(spark, "page_playbill", events=events(spark, 20))
    assert not [line for line in shown.splitlines() if "Filter" in line and "regexp" in line]


def test_conditions_on_a_grids_slots_look_at_what_was_read(spark):
    shown = plan(spark, "page_week_grid", events=events(spark, 20))
    assert not [line for line in shown.splitlines() if "Filter" in line and "split" in line]


def test_one_attribute_is_the_first_of_its_name(spark):
    from lumenloom.sources import markup as M

    tags = ["""<a X='1' x="2" data-x="0">""", """<a b="c d='e' x=" x = 'f"g'>""", "<a x=1 X\t=\n\"\">", "<a b='x'>", None]
    rows = spark.createDataFrame([(t,) for t in tags], "t string").select(M.first_attribute(F.col("t"), "x").alias("one"), F.try_element_at(M.attribute_pairs(F.col("t")), F.lit("x")).alias("of_all"))
    got = [tuple(r) for r in rows.collect()]
    assert [a for a, _ in got] == ["1", 'f"g', "", None, None] and all(a == b for a, b in got)


def test_a_packed_file_is_unpacked_by_one_task_and_read_by_many(spark):
    path = Path(new_path(spark, "packed").removeprefix("file://"))
    path.mkdir(parents=True)
    pieces = [f"{k} " + "x" * (k % 97) for k in range(5000)]
    with gzip.open(path / "x.gz", "wt") as f:
        f.write("</end".join(pieces))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one partition
    try:
        rows = R.read(spark, [str(path)], "</end")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        got = [r.value for r in R.placed(rows, ["provider"]).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 4000 and got == pieces


def test_records_of_one_split_do_not_meet_in_one_task(spark):
    rows = spark.range(2000).select(F.lit(0).alias("provider"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("id").alias("at"), F.lit("x").alias("value"))
    placed = R.placed(rows, ["provider"])
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 1 and placed.agg(F.count_distinct("seq"), F.max("seq")).first()[:] == (2000, 1999)


def test_hostile_files_grow_in_number_and_not_in_size(spark, monkeypatch):
    seen, own = [], m3u.parse

    def parse(files, **limits):
        seen.append(files.agg(F.count("*"), F.max(F.length("value"))).first()[:])
        return own(files, **limits)

    monkeypatch.setattr(m3u, "parse", parse)
    for n in (2000, 6000):
        all_queries()[0]["playlist_hostile"](spark, tables(spark, part=parts(spark, n, F.lit("t"))))
    (few, small), (many, large) = seen
    assert many == 3 * few and large < 1.1 * small


def test_a_written_guide_is_worked_out_once(spark, monkeypatch):
    from lumenloom.operators.guide import Guide
    from lumenloom.sources import xmltv

    seen, own = [], xmltv.render
    monkeypatch.setattr(xmltv, "render", lambda guide: seen.append(guide) or own(guide))
    ch = spark.createDataFrame([(0, 0, "A.tr", "A", None, None)], "provider int, seq long, id string, name string, icon string, url string")
    at = lambda hour: F.concat(F.lit("2026-09-08T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00+03:00"))
    none = [F.lit(None).cast("string").alias(c) for c in ("sub_title", "desc", "category", "icon")]
    pr = spark.range(5).select(F.lit(0).alias("provider"), F.col("id").alias("seq"), F.lit("A.tr").alias("channel"), at(F.col("id")).alias("start"), at(F.col("id") + 1).alias("stop"), F.lit("t").alias("title"), *none).distinct()
    path = new_path(spark, "once")
    xmltv.write(Guide(ch, pr), path)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (seen[0].channels, seen[0].programmes)]
    assert not any("Aggregate" in p or "LogicalRDD" in p for p in plans)
    assert xmltv.read(spark, [path]).programmes.count() == 5


def test_an_element_is_gone_through_once_for_its_attributes_and_once_for_its_children(spark):
    from lumenloom.sources import xmltv

    texts = ['<programme Start = "1" start=\'2\' channel="c &amp; d"><title lang="sv">t</title><title>u</title><icon SRC=\'i\'/><desc/>', "<programme><titles>x</titles><icon>", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, element string")
    found = xmltv._read(rows, ["k"], "title", start=xmltv._own("start"), channel=xmltv._own("channel"), title=xmltv._inner("title"), desc=xmltv._inner("desc"), icon=xmltv._of_inner("icon", "src"))
    assert [tuple(r)[1:] for r in found.orderBy("k").collect()] == [("1", "c & d", "t", None, "i", "sv"), (None,) * 6, (None,) * 6]
    # the element's own two lists, the attributes of the title and of the icon, references
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 6

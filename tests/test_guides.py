from pyspark.sql import functions as F

from lumenloom.operators import guide as G
from lumenloom.operators.guide import Guide
from lumenloom.sources import xmltv
from lumenloom.scratch import new_path

CH = "provider int, seq long, id string, name string, icon string, url string"
PR = "provider int, seq long, channel string, start string, stop string, title string, sub_title string, desc string, category string, icon string"
DAY = "2026-09-08T{}:00+03:00"


def slot(p, n, channel, start, stop, title, category=None):
    return (p, n, channel, DAY.format(start), DAY.format(stop), title, None, None, category, None)


def guide(spark, channels, programmes, language="tr"):
    return Guide(spark.createDataFrame(channels, CH), spark.createDataFrame(programmes, PR), language=language)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_equal_starts_leave_the_last(spark):
    s = spark.createDataFrame([("A", "2026-09-08", 600, 1, "x"), ("A", "2026-09-08", 600, 2, "y"), ("A", "2026-09-08", 1440, 3, "z"), ("A", "2026-09-09", 5, 4, "w")], "channel string, date string, start_min int, seq long, title string").withColumn("date", F.col("date").cast("date"))
    assert rows(G.derive_stops(s), "title", "start_min", "stop_min") == [("w", 5, 1440), ("y", 600, 1440)]
    chained = {r.title: r.stop_at - r.start_at for r in G.chain_stops(s).collect()}
    assert chained["y"] == 840 and chained["z"] == 5 and chained["w"] == 1435


def test_conflicting_titles_survive_the_merge_and_not_the_writer(spark):
    g = guide(spark, [(0, 0, "A.tr", "A", None, None), (1, 0, "a.tr", "A again", "i", "u")], [slot(0, 0, "A.tr", "10:00", "11:00", "A Show"), slot(1, 0, "a.tr", "10:00", "11:00", "B Show"), slot(1, 1, "a.tr", "10:00", "11:00", "A Show")])
    merged, counters = G.merge(g)
    assert rows(merged.programmes, "title") == [("A Show",), ("B Show",)] and counters.first().duplicates == 1
    assert rows(merged.channels, "id", "name", "icon", "url") == [("A.tr", "A", "i", "u")]
    assert rows(G.dedupe_slots(merged.programmes), "title") == [("A Show",)]


def test_exclusive_owner_is_who_lists_the_channel(spark):
    g = guide(spark, [(0, 0, "T.tr", "T", None, None), (1, 0, "T.tr", "T", None, None), (1, 1, "U.tr", "U", None, None)], [slot(1, 0, "T.tr", "10:00", "11:00", "x"), slot(1, 1, "U.tr", "10:00", "11:00", "y")])
    merged, counters = G.merge(g, exclusive=True)
    assert rows(merged.programmes, "title") == [("y",)] and counters.first().shadowed == 1


def test_merge_of_one_guide_is_its_normal_form(spark):
    g = guide(spark, [(0, 0, "A.tr", "A", None, None)], [slot(0, 0, "A.tr", "10:00", "11:00", "x"), slot(0, 1, "A.tr", "10:00", "11:00", "x"), slot(0, 2, "B.tr", "10:00", "11:00", "x"), slot(0, 3, "A.tr", "12:00", "11:00", "x"), slot(0, 4, "A.tr", "12:00", "13:00", " ")])
    clean, issues = G.normalise(g)
    assert rows(G.merge(g)[0].programmes, "seq") == rows(clean.programmes, "seq") == [(0,)]
    assert {r.issue: r["count"] for r in issues.collect()} == {"unknown-channel": 1, "invalid-programme": 2, "duplicate-programme": 1}


def test_aliases():
    got = G.resolve_aliases({"a": "B", "b": "C", "x": "Y", "Y": "x", "n": 3})
    assert got["A"] == got["B"] == "C" and got["X"] == "x" and "N" not in got


def test_compare(spark):
    a = guide(spark, [(0, 0, "A.tr", "A", None, None), (0, 1, "L.tr", "L", None, None)], [slot(0, 0, "A.tr", "10:00", "11:00", "x"), slot(0, 1, "A.tr", "11:00", "12:00", "y", "c"), slot(0, 2, "L.tr", "11:00", "12:00", "y")])
    b = guide(spark, [(0, 0, "a.tr", "A", None, None)], [slot(0, 0, "a.tr", "10:00", "11:00", "x"), slot(0, 1, "a.tr", "11:00", "12:00", "y"), slot(0, 2, "a.tr", "12:00", "13:00", "z")])
    breakdown, differences = G.compare(a, b)
    s = G.compare_summary(breakdown, differences).first()
    assert (s.channels_a, s.channels_b, s.common, s.only_a_channels, s.matched, s.changed, s.only_a, s.only_b) == (2, 1, 1, 1, 1, 1, 1, 1)
    assert [tuple(r.diffs) for r in differences.where("kind = 'changed'").collect()] == [("category",)]
    assert any("[changed]" in x for x in G.report_lines(breakdown, differences, "p", "q"))


def test_xmltv_round_trip_and_hostile_input(spark):
    p = (0, 0, "A.tr", DAY.format("10:00"), DAY.format("11:00"), 'T & "x" <y>', "sub", "desc", "cat", "http://i?a=1&b=2")
    g = Guide(spark.createDataFrame([(0, 0, "A.tr", "A & B", "http://i", "http://u")], CH), spark.createDataFrame([p], PR))
    path = new_path(spark, "xml")
    xmltv.write(g, path)
    back = xmltv.read(spark, [path])
    assert rows(back.programmes, *[c.split()[0] for c in PR.split(", ")]) == [p]
    assert rows(back.channels, "id", "name", "icon", "url") == [("A.tr", "A & B", "http://i", "http://u")]
    bad = '<tv><channel data-id="EVIL" id="A.tr"><display-name/></channel><channel id="A.tr"><display-name>second</display-name></channel><programme start="20260231100000 +0300" stop="20260301100000 +0300" channel="A.tr"><title>x</title></programme><programme start="20260301100000 +0300" stop="20260301090000 +0300" channel="A.tr"><title>x</title></programme><programme start="20260301100000 +0300" stop="20260301110000 +0300" channel="B.tr"><title>x</title></programme><programme start="20260301100000 +0300" stop="20260301110000 +0300" channel="A.tr"><title lang="tr">&amp;amp;</title></programme>'
    got = xmltv.parse(spark.createDataFrame([(0, bad)], "provider int, value string"))
    assert rows(got.channels, "id", "name") == [("A.tr", "A.tr")] and rows(got.programmes, "title") == [("&amp;",)]

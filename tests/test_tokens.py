from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.sources import pages as P
from lumenloom.sources import tokens as K

PAGE = """<!-- saved from a page with a <title>1 Ocak 2001 tarihli</title> and <ul class="epg-list"><li> -->
<html><head><script>if (a < b) s = "<title>2 Ocak 2002 tarihli</title>";</script><style>p > a {}</style>
<title data-x="a>b">TRT 03 Ekim 2026 tarihli Akış</title></head>
<ul CLASS='x epg-list' title="<li>"><li><div class="time"> 06:00 </div><div class="program-name"><div>News &amp; <b>more</b></div> <![CDATA[<at> &amp;]]></div></li>
<li id="a>b"><div class="time">07:30</div><div class="program-name">Late</div>
<li><div class="time">25:00</div><div class="program-name">never</div></li></ul><li><div class="time">08:00</div><div class="program-name">outside</div></li>"""


def rows(spark, value):
    return spark.createDataFrame([("p", value)], "page string, value string")


def test_served_date_and_slots_of_a_page_with_comments_and_scripts(spark):
    got = P.flat_list(rows(spark, PAGE)).orderBy("seq").collect()
    assert [(r.seq, r.start_min, r.title, str(r.served)) for r in got] == [(0, 360, "News & more <at> &amp;", "2026-10-03"), (1, 450, "Late", "2026-10-03")]
    for odd in (None, "", "<", "<ul class=epg-list", "<!-- open <li>", "<script>open", '<a href="', "<ul class=\"epg-list\"><li><div class='time'>"):
        assert P.flat_list(rows(spark, odd)).count() == 0


def tokens_of(spark, value):
    return [(t.name, t.raw) for t in rows(spark, value).select(K.tokens(F.col("value")).alias("t")).first().t]


def test_tokens(spark):
    assert tokens_of(spark, "a<B c='>'>x</B ><!doctype y><?z?>1 < 2<br/>") == [("", "a"), ("b", "<B c='>'>"), ("", "x"), ("/b", "</B >"), ("", "1 "), ("", "<"), ("", " 2"), ("br", "<br/>")]
    assert tokens_of(spark, "<script src=x>a<b></script>t") == [("script", "<script src=x>a<b></script>"), ("", "t")]
    assert tokens_of(spark, "<p title=it's>x</p><p t=\"open>y") == [("p", "<p title=it's>"), ("", "x"), ("/p", "</p>"), ("p", '<p t="open>'), ("", "y")]
    long = "<p " + " ".join(f"a{k}='{k}>'" for k in range(5000)) + ">x"
    assert [n for n, _ in tokens_of(spark, long)] == ["p", ""]


def test_elements_end_where_as_many_are_closed_as_opened(spark):
    value = '<div class="a"><div>1</div><div/>2</div>3<div class="a">4'
    found = K.sections(K.tokens(F.col("value")), ("div", "a"))
    got = rows(spark, value).select(F.transform(found, lambda s: K.words(K.content(s))).alias("w"), K.words(K.until(K.tokens(F.lit("x<a>y")), "a")).alias("u")).first()
    assert got.w == ["12", "4"] and got.u == "x"


def test_references(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#x41;&#65;&#0000065;": "AAA", "&#0;&#x1;&#xD800;&#x110000;&#99999999999;": "&#0;&#x1;&#xD800;&#x110000;&#99999999999;", "&nope; & &amp": "&nope; & &amp", "&Uuml;&#x1F600;": "Ü😀", "": ""}
    df = spark.createDataFrame(list(cases.items()), "given string, want string")
    assert all(r.want == r.got for r in df.select("want", X.decode_entities(F.col("given")).alias("got")).collect())

"""Page parsers over ``events`` and ``part``, rendered into each page's markup and read back.

A page holds one user's events of a day. Of ten events one has a blank title and one an impossible
time; parsers must leave both out and read the others' escaped titles back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import instants as I
from lumenloom.functions import text as X
from lumenloom.plans.registry import query, table
from lumenloom.sources import pages as P

_E = """e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS m, event_type || ' & "' || (event_id % 10) || '"' AS title,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY hour(ts) * 60 + minute(ts), event_id) - 1 AS seq FROM events),
p AS (SELECT user_id || '_' || day AS page, * FROM e), ok AS (SELECT * FROM p WHERE event_id % 10 NOT IN (7, 8))"""


def _two(x: Column) -> Column:
    return F.lpad(x.cast("int").cast("string"), 2, "0")


def _clock(m: Column) -> Column:
    return F.concat(_two(F.floor(m / 60)), F.lit(":"), _two(m % 60))


def days(spark: SparkSession, sf_dir: str, render, wrap) -> DataFrame:
    """``page, day, value``: ``render`` an event (fields ``m, event_id, title, clock``), ``wrap`` the day's events in order."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"), F.concat("event_type", F.lit(' & "'), (F.col("event_id") % 10).cast("string"), F.lit('"')).alias("title"))
    shown = F.when(F.col("event_id") % 10 == 7, F.lit("  ")).otherwise(F.col("title"))
    clock = F.when(F.col("event_id") % 10 == 8, F.lit("25:61")).otherwise(_clock(F.col("m")))
    rows = e.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("m", "event_id", shown.alias("title"), clock.alias("clock")))).alias("all"))
    return rows.select(F.concat_ws("_", "user_id", "day").alias("page"), "day", wrap(F.array_join(F.transform("all", render), ""), F.col("day")).alias("value"))


def _html(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _turkish(day: Column) -> Column:
    names = F.array(*[F.lit(m.capitalize() if m[0] != "ı" else m) for m in I.TURKISH_MONTHS])
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string"))


def _seq(df: DataFrame, *columns) -> DataFrame:
    return df.select("page", F.col("seq").cast("long").alias("seq"), *columns)


_SLOTS = f"WITH {_E} SELECT page, seq, m AS start_min, title"


@query(_SLOTS + ", CAST(day AS VARCHAR) AS served FROM ok")
def page_flat_list(spark, sf_dir):
    item = lambda e: _html('<li  ><div class="time"> ', e["clock"], '</div><div class="program-name"><div><b>', X.escape_xml(e["title"]), "</b></div>  </div></li>\n")
    head = '<!-- a <title>2 Ocak 2002 tarihli</title> in a comment <ul class="epg-list"><li> --><script>if (1 < 2) x = "<title>3 Ocak 2003 tarihli</title>"</script>'
    page = lambda body, day: _html(head + '<title lang="a>b">1 Ocak 2001 gibi, ', _turkish(day), ' tarihli Akış</title><ul><li>9</li></ul>\n<ul class="epg-list">', body, "</ul>")
    return _seq(P.flat_list(days(spark, sf_dir, item, page)), "start_min", "title", F.col("served").cast("string"))


@query(_SLOTS + ", CAST(day AS VARCHAR) AS served FROM ok")
def page_table(spark, sf_dir):
    cell = lambda x: _html('<td style="padding:2px"><strong>', x, "</strong></td>")
    row = lambda e: _html("<tr><td>1.</td>", cell(X.escape_xml(e["title"])), "\n ", cell(e["clock"]), "</tr>")
    page = lambda body, day: _html("<h2>", _turkish(day), " - Salı</h2><table>", body, "</table>")
    out = P.table_rows(days(spark, sf_dir, row, page))
    return _seq(out, "start_min", "title", F.col("served").cast("string"))


@query(_SLOTS + " FROM ok")
def page_zipped_lists(spark, sf_dir):
    """Times and names pair by place; a name too many at the end has no time."""
    item = lambda e: _html('<li><strong class="program-time x">', e["clock"], '</strong>\n<p class="program-name">', X.escape_xml(e["title"]), "</p></li>")
    page = lambda body, day: _html("<ul>", body, '</ul><p class="program-name">too many</p>')
    return _seq(P.zipped_lists(days(spark, sf_dir, item, page)), "start_min", "title")


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / 100).cast("string").alias("page"))


def _dealt_parts(spark, sf_dir) -> DataFrame:
    """Keys of parts, dealt out: what is rendered from them takes long, and a row group of them is one task's."""
    return table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


_CARDS = "c AS (SELECT CAST(p_partkey // 100 AS VARCHAR) AS page, 'kanal-' || (p_partkey // 2) AS slug, p_partkey AS k, p_name AS name FROM part)"


@query(f"WITH {_CARDS} SELECT page, slug, arg_min(name, k) AS name, arg_min(CASE WHEN k % 3 <> 0 THEN 'http://i/' || k || '.png' END, k) FILTER (true) AS icon FROM (SELECT DISTINCT ON (page, slug) * FROM c ORDER BY page, slug, k) GROUP BY ALL")
def page_channel_cards(spark, sf_dir):
    """Two cards of each slug on a page: the first counts; every third icon is no http address."""
    k = F.col("p_partkey").cast("string")
    source = F.when(F.col("p_partkey") % 3 == 0, F.lit("data:x")).otherwise(_html("http://i/", k, ".png"))
    card = _html('<a class="c" href="/tv/kanal-', F.floor(F.col("p_partkey") / 2).cast("string"), '-yayin-akisi-bugun">\n<img src="x.gif" data-src="', source, '" alt=" ', X.escape_xml(F.col("p_name")), ' "></a><a href="/other">no</a>')
    cards = _parts(spark, sf_dir).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("x")))), lambda c: c["x"]), "").alias("value"))
    return P.channel_cards(cards).select("page", "slug", "name", "icon")


@query(f"WITH {_CARDS} SELECT page, slug, arg_min('http://i/' || k || '.png?a=1&b', k) AS icon FROM c WHERE k % 3 <> 0 GROUP BY ALL")
def page_logo_cards(spark, sf_dir):
    """The first sound logo of a slug counts, not the first logo."""
    k = F.col("p_partkey").cast("string")
    source = F.when(F.col("p_partkey") % 3 == 0, F.lit("http://i/a|b")).otherwise(_html("http://i/", k, ".png?a=1&amp;b"))
    card = _html('<a title="t" href="https://h/yayin-akisi/KANAL-', F.floor(F.col("p_partkey") / 2).cast("string"), '/03-10-2026" class="u"><img alt="x" src="', source, '" /></a>')
    cards = _parts(spark, sf_dir).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("x")))), lambda c: c["x"]), "").alias("value"))
    return P.logo_cards(cards).select("page", "slug", "icon")


@query("SELECT CAST(p_partkey AS VARCHAR) AS page, 'https://b/l/' || p_partkey || '.png' AS icon FROM part WHERE p_partkey % 4 <> 0")
def page_table_logo(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    source = F.when(F.col("p_partkey") % 4 == 0, F.lit("data:x")).otherwise(_html("/l/", k, ".png?rkt=9"))
    rows = _dealt_parts(spark, sf_dir).select(k.alias("page"), _html('<img src="/chrome.png"><img alt="a" border="0" src="', source, '">').alias("value"))
    return P.table_logo(rows, "https://b/")


@query("SELECT CAST(p_partkey AS VARCHAR) AS page, 'https://b/' || p_partkey || '&x' AS icon FROM part WHERE p_partkey % 4 <> 0")
def page_brand_logo(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    source = F.when(F.col("p_partkey") % 4 == 0, F.lit("/relative.png")).otherwise(_html("https://b/", k, "&amp;x"))
    rows = _dealt_parts(spark, sf_dir).select(k.alias("page"), _html('<a class="x"><img src="http://no"></a><a href="/" class="nav w-nav-brand w--current">\n<img loading="lazy" src="', source, '"></a>').alias("value"))
    return P.brand_logo(rows)


_GRID = """, g AS (SELECT CAST(user_id // 20 AS VARCHAR) AS page, dense_rank() OVER (PARTITION BY user_id // 20 ORDER BY user_id) - 1 AS channel_no, user_id, event_id, m, title,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, (event_id % 3) * 720 AS span FROM e WHERE event_id % 10 <> 7)"""


@query(f"WITH {_E}{_GRID} SELECT page, 'Ch ' || user_id || ' & co' AS channel, title, CASE event_id % 3 WHEN 1 THEN 'Film' END AS category, m AS start_min, CAST(m + CASE WHEN event_id % 3 = 1 THEN 720 ELSE 1440 END AS INTEGER) AS stop_min FROM g WHERE (m + span) % 1440 >= 0")
def page_week_grid(spark, sf_dir):
    """Rows pair with the rail by place; equal times are a whole day, later ones may cross midnight."""
    e = table(spark, sf_dir, "events").withColumns({"m": F.hour("ts") * 60 + F.minute("ts"), "title": F.concat("event_type", F.lit(' & "'), (F.col("event_id") % 10).cast("string"), F.lit('"'))})
    stop = F.pmod(F.col("m") + (F.col("event_id") % 3) * 720, F.lit(1440))
    shown = F.when(F.col("event_id") % 10 == 7, F.lit(" ")).otherwise(X.escape_xml(F.col("title")))
    cell = _html('<div class="flow-module-col passive" data-type="', (F.col("event_id") % 3).cast("string"), '"><div><h2 class="column-title">', shown, ' <a href="x">more</a></h2><span class="column-time"> ', _clock(F.col("m")), " - ", _clock(stop), "</span></div></div>")
    rows = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", cell.alias("x")))), lambda c: c["x"]), "").alias("cells"))
    rail = _html('<li class="flow-module-channel"><a href="/u"><img src="/i.png?v=1" alt="Ch ', F.col("user_id").cast("string"), ' &amp; co"></a></li>')
    day = rows.groupBy(F.floor(F.col("user_id") / 20).cast("string").alias("page")).agg(F.sort_array(F.collect_list(F.struct("user_id", rail.alias("rail"), _html('<div class="flow-module-row">', F.col("cells"), "</div>").alias("row")))).alias("all"))
    value = F.concat(F.lit("<ul>"), F.array_join(F.transform("all", lambda c: c["rail"]), ""), F.lit("</ul>"), F.array_join(F.transform("all", lambda c: c["row"]), ""))
    channels, slots = P.week_grid(day.select("page", value.alias("value")), {"1": "Film"})
    paired, lost = P.pair_rail(channels, slots)
    return paired.join(lost, "page", "left_anti").select("page", "channel", "title", "category", "start_min", "stop_min")


@query(f"WITH {_E} SELECT CAST(user_id AS VARCHAR) AS page, CAST(day AS VARCHAR) AS date, m AS start_min, title FROM ok WHERE day(day) <> 13")
def page_weekly_cards(spark, sf_dir):
    """A row belongs to the last sound heading before it; what comes before any has none."""
    row = lambda e: _html('<div class="prog-row">\n<span class="prog-time">', e["clock"], '</span> <span class="prog-name">', X.escape_xml(e["title"]), "</span></div>")
    lone = '<div class="prog-row"><span class="prog-time">10:00</span><span class="prog-name">lost</span></div>'
    card = lambda body, day: F.when(F.dayofmonth(day) == 13, F.lit("")).otherwise(_html('<h3 id="d" class="day-title"> Cümə &amp; / ', F.date_format(day, "dd.MM.yyyy"), "</h3>", body))
    cards = days(spark, sf_dir, row, card)
    weeks = cards.groupBy(F.substring_index("page", "_", 1).alias("page")).agg(F.sort_array(F.collect_list(F.struct("day", "value"))).alias("all"))
    value = F.concat(F.lit(lone + '<h3 class="day-title">Heç / 31.02.2026</h3>' + lone), F.array_join(F.transform("all", lambda c: c["value"]), ""))
    return P.weekly_cards(weeks.select("page", value.alias("value"))).select("page", F.col("date").cast("string"), "start_min", "title")


def _quoted(x: Column) -> Column:
    """A JSON string."""
    return F.substring(F.to_json(F.struct(x.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)


@query(_SLOTS + ", CAST(user_id AS BIGINT) AS channel_id, CAST(day AS VARCHAR) AS served FROM ok")
def page_next_data(spark, sf_dir):
    item = lambda e: _html('{"channel_id":"ID","event_time":"', e["clock"], ':00","name":', _quoted(e["title"]), ',"x":[1]},')
    page = lambda body, day: _html('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"activeLeagues":[],"data":{"event_date":"', F.date_format(day, "yyyy-MM-dd"), '","listTvGuides":[', body, "{}]}}}}</script>")
    own = days(spark, sf_dir, item, page).withColumn("value", F.replace("value", F.lit('"ID"'), F.substring_index("page", "_", 1)))
    return _seq(P.next_data(own)[1], "start_min", "title", "channel_id", F.col("served").cast("string"))


@query("SELECT DISTINCT ON (page, slug) CAST(p_size AS VARCHAR) AS page, p_brand AS slug, p_partkey AS channel_id, CASE WHEN p_partkey % 2 = 0 THEN 'http://i/' || p_partkey END AS icon FROM part ORDER BY page, slug, p_partkey")
def page_next_channels(spark, sf_dir):
    """The first league of a slug counts, with its image if that is sound."""
    k = F.col("p_partkey").cast("string")
    league = F.to_json(F.struct(F.col("p_brand").alias("rewriteId"), F.when(F.col("p_partkey") % 2 == 0, _html("http://i/", k)).otherwise("no").alias("image"), k.alias("channelId")))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("string").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", league.alias("x")))), lambda c: c["x"]), ",").alias("body"))
    return P.next_data(rows.select("page", _html('<script id="__NEXT_DATA__">{"props":{"pageProps":{"activeLeagues":[', F.col("body"), "]}}}</script>").alias("value")))[0]


def _event(e: Column, day: Column, channels: str) -> Column:
    return _html('{"name":', _quoted(e["title"]), ',"date_time":"', F.date_format(day, "yyyy-MM-dd"), " ", e["clock"], ':00","sport_name":" Fut  bol ","channels":', channels, "},")


def _events(spark, sf_dir, channels: str, head: str, tail: str) -> DataFrame:
    """Days of JSON events; the day in each is put in afterwards, since an event doesn't know it."""
    item = lambda e: _event(e, F.lit("2001-01-01").cast("date"), channels)
    page = lambda body, day: _html(head, F.replace(body, F.lit("2001-01-01"), F.date_format(day, "yyyy-MM-dd")), tail)
    return days(spark, sf_dir, item, page)


@query(f"WITH {_E} SELECT page, CAST(day AS VARCHAR) AS date, m AS start_min, title, 'Fut bol' AS category FROM ok")
def page_state_events(spark, sf_dir):
    """The state ends where its braces close, whatever its strings hold."""
    own = _events(spark, sf_dir, '[{"name":"Other"},{"name":" tabii  spor"}]', 'x<script>window.__INITIAL_STATE__={"common":{"events":[', r'{"name":"} \" {"}]}};window.y={}</script>')
    return P.state_events(own.withColumn("channel", F.lit("TABII SPOR"))).select("page", F.col("date").cast("string"), "start_min", "title", "category")


@query(f"WITH {_E} SELECT page, CAST(day AS VARCHAR) AS date, m AS start_min, title, unnest(['S1.tr', 'S2.tr']) AS channel FROM ok WHERE day(day) % 2 = 0")
def page_event_envelope(spark, sf_dir):
    """An event goes to each channel that is known, if it falls on the page's day."""
    own = _events(spark, sf_dir, '[{"name":"s  1","icon":"http://i"},{"name":"S 2"},{"name":"S 3"}]', '{"data":[', "{}]}")
    shifted = own.withColumn("day", F.when(F.dayofmonth("day") % 2 == 0, F.col("day")).otherwise(F.date_add("day", 1)))
    return P.event_envelope(shifted, {"S 1": "S1.tr", "S 2": "S2.tr"}).select("page", F.col("date").cast("string"), "start_min", "title", "channel")


_ISO = "strftime(to_timestamp({}) AT TIME ZONE 'Europe/Stockholm', '%Y-%m-%dT%H:%M:%S')"


@query(f"WITH {_E}, k AS (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', CAST(day AS TIMESTAMP)) + m * 60 AS s FROM ok WHERE event_id % 10 <> 6) SELECT page, seq, {_ISO.format('s')} AS start, {_ISO.format('s + 1800')} AS stop, title, 'Säsong ' || (event_id % 5) || ', Avsnitt 3' AS sub_title, 'Drama' AS category FROM k")
def page_state_schedule(spark, sf_dir):
    """JSON within a JSON string; reversed broadcasts are left out, and the first genre with a name counts."""

    def item(e):
        at = lambda s: F.concat((F.lit(77_000_000) + e["m"] * 60 + s).cast("string"), F.lit("000"))
        stop = F.when(e["event_id"] % 10 == 6, at(-60)).otherwise(at(1800))
        title = F.when(e["event_id"] % 10 == 8, F.lit(" ")).otherwise(e["title"])
        return _html('{"title":', _quoted(title), ',"genres":[{"name":" "},{"name":"Drama"}],"seasonNumber":', (e["event_id"] % 5).cast("string"), ',"episodeNumber":3,"broadcast":{"startTime":', at(0), ',"endTime":', stop, "}},")

    made = days(spark, sf_dir, item, lambda body, day: body)
    # the times are written with a base that each page replaces by its own day's
    seconds = F.unix_date("day").cast("long") * 86400
    shifted = F.array_join(F.transform(F.split("value", r'(?<="startTime":)|(?<="endTime":)'), lambda x: F.when(x.rlike("^77"), F.concat((F.substring(x, 1, 8).try_cast("long") - 77_000_000 + seconds).cast("string"), F.substring(x, 9, 2**31 - 1))).otherwise(x)), "")
    inner = F.concat(F.lit('{"schedule":{"id":"1","broadcasts":['), shifted, F.lit("{}]}}"))
    own = made.select("page", _html("<script>window.__INITIAL_STATE__ = ", _quoted(inner), ";</script>").alias("value"))
    return _seq(P.state_schedule(own), F.left("start", F.lit(19)).alias("start"), F.left("stop", F.lit(19)).alias("stop"), "title", "sub_title", "category")


@query(f"WITH {_E} SELECT page, seq, strftime(day, '%Y-%m-%d') || 'T' || lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || ':00+03:00' AS start, strftime(day + 1, '%Y-%m-%dT00:00:00+03:00') AS stop, title, 'x' AS category FROM ok WHERE event_id % 10 <> 6")
def page_playbill(spark, sf_dir):
    """Instants in UTC+03:00 only; 24:00 is the next day's start."""

    def item(e):
        zone = F.when(e["event_id"] % 10 == 6, F.lit("UTC+02:00")).otherwise(F.lit("UTC+03:00"))
        return _html('{"starttime":"2001-01-01 ', e["clock"], ":00 ", zone, '","endtime":"2001-01-01 24:00 ', zone, '","name":', _quoted(e["title"]), ',"genres":" x "},')

    own = days(spark, sf_dir, item, lambda body, day: _html('{"counttotal":"1","playbilllist":[', F.replace(body, F.lit("2001-01-01"), F.date_format(day, "yyyy-MM-dd")), "{}]}"))
    return _seq(P.playbill(own), "start", "stop", "title", "category")


@query(f"WITH {_E} SELECT page, seq, CAST(day AS VARCHAR) AS begin_date, m AS begin_min, CAST(day + 1 AS VARCHAR) AS end_date, CAST(5 AS INTEGER) AS end_min, title FROM ok WHERE event_id % 10 <> 6")
def page_prevue(spark, sf_dir):
    """Wall times with dots; what ends before it begins is left out."""

    def item(e):
        end = F.when(e["event_id"] % 10 == 6, F.lit("2000.01.01 00:05:00")).otherwise(F.lit("2001.01.02 00:05:00"))
        return _html('{"prevueName":', _quoted(e["title"]), ',"genre":"","beginTime":"2001.01.01 ', e["clock"], ':00","endTime":"', end, '","description":" a  b ","other":{}},')

    swap = lambda body, day: F.replace(F.replace(body, F.lit("2001.01.01"), F.date_format(day, "yyyy.MM.dd")), F.lit("2001.01.02"), F.date_format(F.date_add(day, 1), "yyyy.MM.dd"))
    own = days(spark, sf_dir, item, lambda body, day: _html('{"mobilPrevueViewModel":[', swap(body, day), "null]}"))
    return _seq(P.prevue(own), F.col("begin_date").cast("string"), "begin_min", F.col("end_date").cast("string"), "end_min", "title")


@query("SELECT CAST(p_size AS VARCHAR) AS page, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'http://c/' WHEN p_partkey % 3 = 1 THEN 'https://p/' ELSE 'http://i/' END || p_partkey AS icon FROM part")
def page_logo_priority(spark, sf_dir):
    """Of the kinds of pictures the first that has a sound address counts, and of its addresses the first sound one."""
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    picture = F.struct(F.when(kind == 0, _html("ftp://x, http://c/", k, ",http://late")).otherwise("a|b").alias("channelpic"), F.when(kind == 1, _html("https://p/", k)).when(kind == 0, "http://never").otherwise("").alias("poster"), _html("http://i/", k).alias("icon"))
    entry = F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("name"), picture.alias("picture")))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("string").alias("page")).agg(_html('{"channellist":[', F.array_join(F.collect_list(entry), ","), "]}").alias("value"))
    return P.channel_list_logos(rows)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS page, 'https://' || n_name AS https FROM nation WHERE n_nationkey % 3 = 0")
def page_platform_address(spark, sf_dir):
    """Answers without an address, or that are no JSON, give nothing."""
    k = F.col("n_nationkey") % 3
    value = F.when(k == 0, F.to_json(F.struct(F.lit("http://x").alias("http"), F.concat(F.lit("https://"), "n_name").alias("https")))).when(k == 1, '{"https":""}').otherwise("<html>")
    return P.platform_address(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("page"), value.alias("value")))

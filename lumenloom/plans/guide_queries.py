"""Guide operators over ``events``: a user is a channel, an event type a title, odd and even ids two providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import instants as I
from lumenloom.operators import guide as G
from lumenloom.operators.guide import Guide
from lumenloom.plans.registry import query, table


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 2).cast("int").alias("provider"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "Ch").otherwise("CH"), F.col("user_id").cast("string"), F.lit(".se")).alias("channel"),
        F.to_date("ts").alias("date"), (F.hour("ts") * 60 + F.minute("ts")).alias("start_min"), F.col("event_type").alias("title"), F.col("props").alias("desc"),
    )


def programmes(derived: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return derived.select("provider", "seq", "channel", I.wall_to_instant(F.col("date"), F.col("start_min")).alias("start"), I.wall_to_instant(F.col("date"), F.col("stop_min")).alias("stop"), "title", none.alias("sub_title"), "desc", none.alias("category"), none.alias("icon"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = slots(spark, sf_dir).groupBy("provider", F.col("channel").alias("id")).agg(F.min("seq").alias("seq"))
    number = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    icon = F.when(number % 3 == F.col("provider"), F.concat(F.lit("http://i/"), F.col("provider").cast("string"), F.lit("/"), number.cast("string")))
    return own.select("provider", "seq", "id", F.concat(F.lit("Name "), F.col("id")).alias("name"), icon.alias("icon"), F.lit(None).cast("string").alias("url"))


def guide(spark: SparkSession, sf_dir: str) -> Guide:
    return Guide(channels(spark, sf_dir), programmes(G.derive_stops(slots(spark, sf_dir))))


def one(g: Guide, provider: int) -> Guide:
    return Guide(g.channels.where(F.col("provider") == provider), g.programmes.where(F.col("provider") == provider))


_SLOTS = """s AS (SELECT event_id AS seq, CAST(event_id % 2 AS INTEGER) AS provider, CASE WHEN event_id % 2 = 0 THEN 'Ch' ELSE 'CH' END || user_id || '.se' AS channel,
  CAST(ts AS DATE) AS date, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS start_min, event_type AS title, props AS "desc" FROM events)"""
_DERIVED = _SLOTS + """, w AS (SELECT *, lead(start_min, 1, 1440) OVER (PARTITION BY channel, date ORDER BY start_min, seq) AS stop_min FROM s),
d AS (SELECT * FROM w WHERE stop_min > start_min)"""
_AT = "strftime(date + CAST({0} // 1440 AS INTEGER), '%Y-%m-%d') || 'T' || lpad(CAST({0} % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') || ':00+03:00'"
_PROGRAMMES = _DERIVED + f""", p AS (SELECT provider, seq, channel, {_AT.format("start_min")} AS start, {_AT.format("stop_min")} AS stop, title, "desc" FROM d),
c AS (SELECT provider, channel AS id, min(seq) AS seq, 'Name ' || channel AS name, CASE WHEN CAST(regexp_extract(channel, '(\\d+)', 1) AS INTEGER) % 3 = provider THEN 'http://i/' || provider || '/' || regexp_extract(channel, '(\\d+)', 1) END AS icon FROM s GROUP BY ALL),
u AS (SELECT upper(id) AS key, arg_min(id, provider) AS id, arg_min(name, provider) AS name, arg_min(icon, provider) FILTER (icon IS NOT NULL) AS icon, min(provider) AS owner FROM c GROUP BY 1),
k AS (SELECT p.*, u.id AS spelling, u.owner FROM p JOIN u ON upper(p.channel) = u.key)"""
_CAST = "CAST(date AS VARCHAR) AS date"


@query(f"WITH {_DERIVED} SELECT channel, {_CAST}, start_min, stop_min, title, seq FROM d")
def derive_stops(spark, sf_dir):
    return G.derive_stops(slots(spark, sf_dir)).select("channel", F.col("date").cast("string"), "start_min", "stop_min", "title", "seq")


@query(f"WITH {_SLOTS}, w AS (SELECT *, date_diff('day', DATE '1970-01-01', date) * 1440 + start_min AS start_at FROM s), x AS (SELECT *, coalesce(lead(start_at) OVER (PARTITION BY channel ORDER BY date, start_min, seq), date_diff('day', DATE '1970-01-01', date) * 1440 + 1440) AS stop_at FROM w) SELECT channel, seq, start_at, stop_at FROM x WHERE stop_at > start_at")
def chain_stops(spark, sf_dir):
    return G.chain_stops(slots(spark, sf_dir)).select("channel", "seq", F.col("start_at").cast("long").alias("start_at"), F.col("stop_at").cast("long").alias("stop_at"))


@query(f"WITH {_SLOTS}, w AS (SELECT *, lead(start_min, 1, 1440) OVER (PARTITION BY channel, date ORDER BY start_min, title, seq) AS stop_min FROM s) SELECT channel, {_CAST}, start_min, stop_min, title FROM w WHERE stop_min > start_min")
def chain_stops_title_tiebreak(spark, sf_dir):
    return G.derive_stops_by_title(slots(spark, sf_dir)).select("channel", F.col("date").cast("string"), "start_min", "stop_min", "title")


def _broken(spark, sf_dir) -> Guide:
    """A guide with blank titles, reversed slots and channels that are not listed."""
    g = guide(spark, sf_dir)
    number = F.regexp_extract("channel", r"(\d+)", 1).cast("int")
    p = g.programmes.withColumns({"title": F.when(F.col("seq") % 11 == 0, F.lit("  ")).otherwise(F.col("title")), "stop": F.when(F.col("seq") % 13 == 0, F.col("start")).otherwise(F.col("stop")), "channel": F.when(number % 7 == 0, F.concat(F.lit("X"), F.col("channel"))).otherwise(F.col("channel"))})
    return Guide(g.channels, p)


_ISSUE = _PROGRAMMES + """, i AS (SELECT *, CASE WHEN CAST(regexp_extract(channel, '(\\d+)', 1) AS INTEGER) % 7 = 0 THEN 'unknown-channel' WHEN seq % 11 = 0 OR seq % 13 = 0 THEN 'invalid-programme' END AS issue FROM p)"""


@query(f"WITH {_ISSUE}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, start, stop, title ORDER BY seq) AS n FROM i WHERE issue IS NULL) SELECT channel, start, stop, title, seq FROM r WHERE n = 1")
def sanitize_guide(spark, sf_dir):
    return G.normalise(_broken(spark, sf_dir))[0].programmes.select("channel", "start", "stop", "title", "seq")


@query(f"WITH {_ISSUE}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, start, stop, title ORDER BY seq) AS n FROM i WHERE issue IS NULL) SELECT issue, count(*) AS count FROM (SELECT issue FROM i WHERE issue IS NOT NULL UNION ALL SELECT 'duplicate-programme' FROM r WHERE n > 1) GROUP BY issue")
def issue_counts(spark, sf_dir):
    return G.normalise(_broken(spark, sf_dir))[1]


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit(0).alias("provider"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").cast("string").alias("channel"), F.col("l_suppkey").cast("string").alias("start"), F.col("l_returnflag").alias("stop"), F.col("l_linestatus").alias("title"))


_LINES = "l AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CAST(l_partkey AS VARCHAR) AS channel, CAST(l_suppkey AS VARCHAR) AS start, l_returnflag AS stop, l_linestatus AS title FROM lineitem)"


@query(f"WITH {_LINES} SELECT channel, start, stop, title, min(seq) AS seq FROM l GROUP BY ALL")
def identity_dedupe(spark, sf_dir):
    return G.dedupe_identity(_lines(spark, sf_dir)).select("channel", "start", "stop", "title", "seq")


@query(f"WITH {_PROGRAMMES}, r AS (SELECT *, row_number() OVER (PARTITION BY upper(channel), start, stop ORDER BY provider, seq) AS n FROM p) SELECT upper(channel) AS channel, start, stop, title, seq FROM r WHERE n = 1")
def slot_dedupe(spark, sf_dir):
    p = guide(spark, sf_dir).programmes.withColumn("channel", F.upper("channel"))
    return G.dedupe_slots(p).select("channel", "start", "stop", "title", "seq")


@query(f"WITH {_PROGRAMMES}, r AS (SELECT *, row_number() OVER (PARTITION BY spelling, start, stop, title ORDER BY provider, seq) AS n FROM k) SELECT provider, seq, spelling AS channel, start, stop, title, \"desc\" FROM r WHERE n = 1")
def merge_additive(spark, sf_dir):
    return G.merge(guide(spark, sf_dir))[0].programmes.select("provider", "seq", "channel", "start", "stop", "title", "desc")


@query(f"WITH {_PROGRAMMES}, r AS (SELECT *, row_number() OVER (PARTITION BY spelling, start, stop, title ORDER BY seq) AS n FROM k WHERE provider = owner) SELECT provider, seq, spelling AS channel, start, stop, title FROM r WHERE n = 1")
def merge_exclusive(spark, sf_dir):
    return G.merge(guide(spark, sf_dir), exclusive=True)[0].programmes.select("provider", "seq", "channel", "start", "stop", "title")


@query(f"WITH {_PROGRAMMES}, o AS (SELECT *, row_number() OVER (PARTITION BY provider, channel, start, stop, title ORDER BY seq) AS n FROM k), g AS (SELECT * FROM o WHERE n = 1) SELECT count(*) FILTER (provider = owner) AS programmes, CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (provider > owner) AS shadowed, (SELECT count(*) FROM u) AS channels, CAST(5 AS BIGINT) AS days, CAST(2 AS BIGINT) AS failures, CAST(1 AS BIGINT) AS mixed_language FROM g")
def merge_counters(spark, sf_dir):
    """Two guides of unlike languages: days and failures are theirs together."""
    g = guide(spark, sf_dir)
    return G.merge(Guide(g.channels, g.programmes, 3 + 2, 0 + 2, "tr", ("tr", "sv")), exclusive=True)[1]


@query(f"WITH {_PROGRAMMES} SELECT id, name, icon FROM u")
def channel_backfill(spark, sf_dir):
    return G.merge(guide(spark, sf_dir))[0].channels.select("id", "name", "icon")


#: Chains, a cycle, a self-reference and a target that is no text.
ALIASES = {"NATION_1": "NATION_2", "nation_2": "NATION_5", "NATION_3": "nation_4", "NATION_4": "NATION_3", "NATION_6": "NATION_6", "NATION_7": 7}


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'NATION_5' WHEN 'NATION_2' THEN 'NATION_5' ELSE n_name END AS canonical FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_4') UNION ALL SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'NATION_3' ELSE 'nation_4' END FROM nation WHERE n_name IN ('NATION_3', 'NATION_4')")
def alias_resolve(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", G.canonical_id(F.col("n_name"), ALIASES).alias("canonical"))


def _compared(spark, sf_dir):
    """All events on both sides: the first as they are, the second with some titles changed, some slots gone and some channels not listed."""
    g = guide(spark, sf_dir)
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("int")
    whole = lambda df: df.withColumn("provider", F.lit(0))
    p = g.programmes.withColumn("title", F.when(F.col("seq") % 14 == 0, F.lit("other")).otherwise(F.col("title")))
    # a channel and its other spelling are one
    return G.compare(Guide(whole(g.channels), whole(g.programmes.where(F.col("seq") % 8 != 0))), Guide(whole(g.channels.where(number("id") % 9 != 0)), whole(p.where("seq % 10 <> 0").where(number("channel") % 9 != 0))))


_COMPARED = _PROGRAMMES + """, n AS (SELECT *, upper(channel) AS key, CAST(regexp_extract(channel, '(\\d+)', 1) AS INTEGER) % 9 <> 0 AS in_b FROM p),
na AS (SELECT DISTINCT ON (channel, start, stop, title) * FROM n WHERE seq % 8 <> 0 ORDER BY channel, start, stop, title, seq),
nb AS (SELECT DISTINCT ON (channel, start, stop, title) * FROM (SELECT * REPLACE (CASE WHEN seq % 14 = 0 THEN 'other' ELSE title END AS title) FROM n WHERE seq % 10 <> 0 AND in_b) ORDER BY channel, start, stop, title, seq),
a AS (SELECT DISTINCT ON (key, start, stop) key, start, stop, title FROM na ORDER BY key, start, stop, seq),
b AS (SELECT DISTINCT ON (key, start, stop) key, start, stop, title FROM nb ORDER BY key, start, stop, seq),
ch AS (SELECT upper(id) AS key, min(id) AS channel, bool_or(CAST(regexp_extract(id, '(\\d+)', 1) AS INTEGER) % 9 <> 0) AS in_b FROM c GROUP BY 1),
f AS (SELECT key, start, stop, a.title AS title_a, b.title AS title_b, CASE WHEN b.title IS NULL THEN 'only_a' WHEN a.title IS NULL THEN 'only_b' WHEN a.title <> b.title THEN 'changed' ELSE 'matched' END AS kind FROM a FULL JOIN b USING (key, start, stop)),
br AS (SELECT channel, true AS in_a, in_b, (SELECT count(*) FROM na WHERE na.key = ch.key) AS programmes_a, (SELECT count(*) FROM nb WHERE nb.key = ch.key) AS programmes_b,
  (SELECT count(*) FROM f WHERE f.key = ch.key AND kind = 'matched' AND in_b) AS matched, (SELECT count(*) FROM f WHERE f.key = ch.key AND kind = 'changed' AND in_b) AS changed,
  (SELECT count(*) FROM f WHERE f.key = ch.key AND kind = 'only_a' AND in_b) AS only_a, (SELECT count(*) FROM f WHERE f.key = ch.key AND kind = 'only_b' AND in_b) AS only_b FROM ch)"""


@query(f"WITH {_COMPARED} SELECT * FROM br")
def compare_breakdown(spark, sf_dir):
    return _compared(spark, sf_dir)[0]


@query(f"WITH {_COMPARED} SELECT count(*) AS channels_a, count(*) FILTER (in_b) AS channels_b, count(*) FILTER (in_b) AS common, count(*) FILTER (NOT in_b) AS only_a_channels, CAST(0 AS BIGINT) AS only_b_channels, CAST(sum(programmes_a) AS BIGINT) AS programmes_a, CAST(sum(programmes_b) AS BIGINT) AS programmes_b, CAST(sum(matched) AS BIGINT) AS matched, (SELECT count(*) FROM f WHERE kind = 'changed') AS changed, (SELECT count(*) FROM f WHERE kind = 'only_a') AS only_a, (SELECT count(*) FROM f WHERE kind = 'only_b') AS only_b FROM br")
def compare_summary(spark, sf_dir):
    return G.compare_summary(*_compared(spark, sf_dir))


@query(f"WITH {_COMPARED} SELECT kind, channel, start, stop, title_a, title_b FROM f JOIN ch USING (key) WHERE kind <> 'matched'")
def compare_changes(spark, sf_dir):
    return _compared(spark, sf_dir)[1].select("kind", "channel", "start", "stop", F.col("a.title").alias("title_a"), F.col("b.title").alias("title_b"))


@query(f"WITH {_PROGRAMMES} SELECT channel, start, title, seq FROM p WHERE channel IN ('Ch1.se', 'CH2.se', 'Ch3.se')")
def subset_filter(spark, sf_dir):
    return G.keep_channels(guide(spark, sf_dir), ["Ch1.se", "CH2.se", "Ch3.se"]).programmes.select("channel", "start", "title", "seq")


@query(f"WITH {_PROGRAMMES} SELECT channel, start, stop, title, seq, row_number() OVER (ORDER BY channel, start, provider, seq) AS place FROM p")
def published_order(spark, sf_dir):
    """Every programme with its place in the published order."""
    return G.with_place(guide(spark, sf_dir).programmes).select("channel", "start", "stop", "title", "seq", "place")


@query(f"WITH {_COMPARED} SELECT (SELECT count(*) FROM ch) AS http_channels, (SELECT count(*) FROM ch WHERE in_b) AS browser_channels, (SELECT count(*) FROM f WHERE kind = 'changed') AS changed, (SELECT count(*) FROM f WHERE kind = 'only_a') AS only_http, (SELECT count(*) FROM f WHERE kind = 'only_b') AS only_browser")
def fetch_mode_report(spark, sf_dir):
    """The same comparison, told as one of two ways to fetch a guide."""
    return G.fetch_mode_summary(*_compared(spark, sf_dir)).select("http_channels", "browser_channels", "changed", "only_http", "only_browser")


@query(f"WITH {_PROGRAMMES}, k2 AS (SELECT DISTINCT n_nationkey AS n FROM nation) SELECT 'missing' AS side, 'CH' || n || '.SE' AS key FROM k2 WHERE 'CH' || n || '.SE' NOT IN (SELECT key FROM u) UNION ALL SELECT 'stray', key FROM u WHERE key NOT IN (SELECT 'CH' || n || '.SE' FROM k2)")
def catalog_reconciliation(spark, sf_dir):
    """Ids that a catalog lists and the guide lacks, and the other way round."""
    listed = table(spark, sf_dir, "nation").select(F.concat(F.lit("ch"), F.col("n_nationkey").cast("string"), F.lit(".se")).alias("id"))
    return G.reconcile(listed, G.merge(guide(spark, sf_dir))[0].channels)


@query("SELECT event_id, CAST(unnest(generate_series(CAST(ts AS DATE) - INTERVAL 1 DAY, CAST(ts AS DATE) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE)::VARCHAR AS day FROM events")
def date_window(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.transform(I.date_window(F.to_date("ts"), 1, 2), lambda d: d.cast("string"))).alias("day"))


@query("SELECT event_id, CAST(unnest(generate_series(date_trunc('week', CAST(ts AS DATE)), date_trunc('week', CAST(ts AS DATE)) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE)::VARCHAR AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events")
def week_window(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.transform(I.week_days(F.to_date("ts")), lambda d: d.cast("string"))).alias("day"), F.weekday(F.to_date("ts")).alias("weekday"))


def _shifted(spark, sf_dir) -> DataFrame:
    """Epoch milliseconds of events, half a year later for every other one, so that both halves of the year occur."""
    seconds = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return table(spark, sf_dir, "events").select("event_id", ((seconds + F.when(F.col("event_id") % 2 == 0, 182 * 86400).otherwise(0)) * 1000).alias("ms"))


_MS = "e AS (SELECT event_id, (date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) + CASE WHEN event_id % 2 = 0 THEN 182 * 86400 ELSE 0 END) * 1000 AS ms FROM events), z AS (SELECT *, to_timestamp(ms / 1000.0) AT TIME ZONE 'Europe/Stockholm' AS wall FROM e)"


@query(f"WITH {_MS} SELECT event_id, strftime(wall, '%Y-%m-%d') AS day FROM z")
def bucket_local_date(spark, sf_dir):
    return _shifted(spark, sf_dir).select("event_id", F.to_date(I.local_wall(F.col("ms"), "Europe/Stockholm")).cast("string").alias("day"))


@query(f"WITH {_MS} SELECT event_id, CAST(date_diff('minute', make_timestamp(ms * 1000), wall) AS INTEGER) AS offset_minutes, strftime(wall, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_diff('minute', make_timestamp(ms * 1000), wall) = 120 THEN '+02:00' ELSE '+01:00' END AS iso FROM z")
def dst_offset(spark, sf_dir):
    ms = F.col("ms")
    return _shifted(spark, sf_dir).select("event_id", I.zone_offset_minutes(ms, "Europe/Stockholm").alias("offset_minutes"), I.epoch_to_iso(ms, "Europe/Stockholm").alias("iso"))


@query(f"WITH {_PROGRAMMES} SELECT seq, replace(replace(replace(start[1:19], '-', ''), ':', ''), 'T', '') || ' +0300' AS xmltv, start AS back, date_diff('second', TIMESTAMP '1970-01-01', CAST(start[1:19] AS TIMESTAMP)) - 10800 AS epoch FROM p")
def xmltv_timestamps(spark, sf_dir):
    p = guide(spark, sf_dir).programmes
    x = I.to_xmltv(F.col("start"))
    return p.select("seq", x.alias("xmltv"), I.from_xmltv(x).alias("back"), I.guide_epoch(F.col("start")).alias("epoch"))

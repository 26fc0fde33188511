"""Playlist operators over ``part``, ``lineitem``, ``orders`` and ``pages``: a part is a channel's entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import playlist as P
from lumenloom.operators.graph import components
from lumenloom.operators.playlist import Rule
from lumenloom.plans.registry import query, table


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries: brand and size make the declared id, the type the group, every ninth has backups."""
    key = F.col("p_partkey")
    url = lambda k: F.concat(F.lit("http://h"), (key % 50).cast("string"), F.lit(".tv/"), F.floor(key / F.lit(2)).cast("string"), F.lit(f"{k}.m3u8"))
    attributes = F.when(key % 9 == 0, F.create_map(F.lit("yedek2"), url("b"), F.lit("yedek"), url("a"), F.lit("yedek3"), F.lit(" "), F.lit("other"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "part").select(
        key.alias("entry_id"), F.concat(F.lit("s"), (key % 3).cast("string")).alias("source_id"), (key % 3).cast("int").alias("source_order"), (key % 4).cast("double").alias("weight"), F.col("p_size").alias("line"),
        F.col("p_name").alias("name"), F.lit("").alias("tvg_id"), F.concat_ws(" ", "p_name", "p_brand").alias("tvg_name"), F.lit("").alias("tvg_logo"), F.col("p_type").alias("group_title"),
        attributes.alias("attributes"), F.array().cast("array<string>").alias("vlc_options"), url("").alias("url"),
    )


WANT, EXCLUDE = ["red *", "*bolt", "no such thing"], ["* brand 3", "*ECONOMY*"]
_FORMS = "f AS (SELECT p_partkey, upper(p_name) AS a, trim(regexp_replace(upper(p_name || ' ' || p_brand), '[^A-Z0-9]+', ' ', 'g')) AS b, upper(p_type) AS c FROM part)"
_KEPT = _FORMS + ", l AS (SELECT * FROM f WHERE NOT (a LIKE '%BRAND 3' OR b LIKE '%BRAND 3' OR c LIKE '%BRAND 3' OR a LIKE '%ECONOMY%' OR b LIKE '%ECONOMY%' OR c LIKE '%ECONOMY%'))"


@query(f"WITH {_KEPT} SELECT p_partkey AS entry_id, a AS name FROM l WHERE a LIKE 'RED%' OR b LIKE 'RED%' OR c LIKE 'RED%' OR a LIKE '%BOLT' OR b LIKE '%BOLT' OR c LIKE '%BOLT'")
def select_globs(spark, sf_dir):
    return P.select(entries(spark, sf_dir), WANT, EXCLUDE)[0].select("entry_id", F.upper("name").alias("name"))


@query("SELECT 'no such thing' AS pattern")
def unmatched_patterns(spark, sf_dir):
    return P.select(entries(spark, sf_dir), WANT, EXCLUDE)[1]


RULES = [Rule("red *", group="reds"), Rule("* bolt", group="bolts", id="bolt.tr", name="Bolt"), Rule("red bolt*", id="redbolt.tr")]


@query(f"WITH {_FORMS} SELECT p_partkey AS entry_id, CASE WHEN a LIKE 'RED%' OR b LIKE 'RED%' THEN 'Reds' WHEN a LIKE '%BOLT' OR b LIKE '%BOLT' THEN 'Bolts' ELSE upper(c[1]) || lower(c[2:]) END AS group_title, CASE WHEN a LIKE '%BOLT' OR b LIKE '%BOLT' THEN 'bolt.tr' WHEN a LIKE 'RED BOLT%' OR b LIKE 'RED BOLT%' THEN 'redbolt.tr' ELSE '' END AS tvg_id FROM f")
def override_first_match(spark, sf_dir):
    return P.override(entries(spark, sf_dir), RULES).select("entry_id", "group_title", "tvg_id")


_URL = "'http://h' || (p_partkey % 50) || '.tv/' || (p_partkey // 2) || '{}.m3u8'"


@query(f"SELECT p_partkey AS entry_id, 0 AS copy_no, {_URL.format('')} AS url FROM part UNION ALL SELECT p_partkey, 1, {_URL.format('a')} FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 2, {_URL.format('b')} FROM part WHERE p_partkey % 9 = 0")
def expand_backups(spark, sf_dir):
    return P.expand_backups(entries(spark, sf_dir)).select("entry_id", "copy_no", "url")


_KEYS = "k AS (SELECT p_partkey AS id, unnest([p_brand || '|' || p_size, p_type || '|' || p_size]) AS key FROM part)"
_WALK = f"WITH RECURSIVE {_KEYS}, lnk AS (SELECT DISTINCT a.key AS x, b.key AS y FROM k a JOIN k b ON a.id = b.id), r AS (SELECT x, y FROM lnk UNION SELECT r.x, lnk.y FROM r JOIN lnk ON r.y = lnk.x), c AS (SELECT x AS key, min(y) AS label FROM r GROUP BY x), o AS (SELECT DISTINCT k.id, c.label FROM k JOIN c USING (key))"


def _labelled(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.array(F.concat_ws("|", "p_brand", "p_size"), F.concat_ws("|", "p_type", "p_size")).alias("keys"))
    edges = part.select(F.col("keys")[0].alias("u"), F.col("keys")[1].alias("v")).distinct()
    labels = components(edges).withColumnRenamed("node", "key")
    return part.withColumn("key", F.col("keys")[0]).join(labels, "key", "left").select(F.col("p_partkey").alias("id"), F.coalesce("label", "key").alias("label"))


@query(_WALK + " SELECT id, label FROM o")
def connected_components(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(_WALK + ", n AS (SELECT label, count(*) AS size FROM o GROUP BY label) SELECT size, count(*) AS components FROM n GROUP BY size")
def component_sizes(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entries of their part's channel."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        # an order's line number occurs again in these tables: supplier and quantity make the id unique
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("entry_id"), F.lit(0).alias("copy_no"), F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("channel_key"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source_id"),
        (F.col("l_suppkey") % 5).cast("int").alias("source_order"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("line"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"), F.lit("").alias("tvg_id"), F.lit("").alias("tvg_name"), F.lit("").alias("tvg_logo"),
        F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("group_title"), F.create_map().cast("map<string,string>").alias("attributes"), F.array().cast("array<string>").alias("vlc_options"), F.concat(F.lit("http://s"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".tv/"), F.col("l_partkey").cast("string"), F.lit("?q="), F.col("l_linenumber").cast("string")).alias("url"),
    )


_LINES = "l AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS entry_id, lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS channel_key, 's' || (l_suppkey % 5) AS source_id, l_suppkey % 5 AS source_order, l_quantity AS weight, l_linenumber AS line, 'Part ' || l_partkey AS base, upper(l_returnflag) || ' ' || upper(l_linestatus) AS label, 'http://s' || (l_suppkey % 7) || '.tv/' || l_partkey AS feed, l_linenumber FROM lineitem)"
_FEEDS = _LINES + ", c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_key, feed ORDER BY entry_id) AS fn FROM l) WHERE fn = 1)"
_RANKED = _FEEDS + ", r AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY weight DESC, source_order, line, entry_id) - 1 AS k, count(*) OVER (PARTITION BY channel_key) AS feeds FROM c)"


@query(f"WITH {_FEEDS} SELECT channel_key, entry_id, feed || '?q=' || l_linenumber AS url FROM c")
def collapse_feeds(spark, sf_dir):
    return P.collapse_feeds(grouped(spark, sf_dir)).select("channel_key", "entry_id", "url")


@query(f"WITH {_RANKED} SELECT channel_key, entry_id, k AS copy_index FROM r")
def rank_copies(spark, sf_dir):
    return P.rank_copies(P.collapse_feeds(grouped(spark, sf_dir))).select("channel_key", "entry_id", F.col("copy_index").cast("long").alias("copy_index"))


@query(f"WITH {_RANKED} SELECT channel_key, entry_id FROM r WHERE k < 3")
def cap_copies(spark, sf_dir):
    return P.cap_copies(P.collapse_feeds(grouped(spark, sf_dir)), 3).select("channel_key", "entry_id")


@query(f"WITH {_RANKED}, b AS (SELECT channel_key, arg_min(label, k) AS base FROM r GROUP BY 1), n AS (SELECT channel_key, label, count(*) AS n, min(entry_id) AS seen FROM c GROUP BY ALL), v AS (SELECT n.*, row_number() OVER (PARTITION BY channel_key ORDER BY n DESC, label <> base, seen) AS p FROM n JOIN b USING (channel_key)) SELECT channel_key, label AS group_title FROM v WHERE p = 1")
def label_vote(spark, sf_dir):
    return P.vote_labels(P.collapse_feeds(grouped(spark, sf_dir))).select("channel_key", "group_title").distinct()


def _named(spark, sf_dir, style):
    return P.name_copies(P.collapse_feeds(grouped(spark, sf_dir)), style)[0].select("channel_key", F.col("copy_index").cast("long").alias("copy_index"), "name", "id")


_SLUG = "replace(upper({0}), ' ', '.') || '.tr'"


def _sql(name: str) -> str:
    return f"WITH {_RANKED}, n AS (SELECT channel_key, k AS copy_index, CASE WHEN k = 0 THEN base ELSE {name} END AS name FROM r) SELECT channel_key, copy_index, name, regexp_replace(regexp_replace(upper(name), '[^A-Z0-9]+', '.', 'g'), '\\.$', '') || '.tr' AS id FROM n"


@query(_sql("base || ' B' || (k + 1)"))
def name_numbered(spark, sf_dir):
    return _named(spark, sf_dir, "numbered")


@query(_sql("CASE WHEN k = 1 THEN base || ' Backup' ELSE base || ' Backup ' || k END"))
def name_backup(spark, sf_dir):
    return _named(spark, sf_dir, "backup")


@query(_sql("base || ' (' || k || ')'"))
def name_parenthesized(spark, sf_dir):
    return _named(spark, sf_dir, "parenthesized")


@query(f"WITH {_RANKED} SELECT channel_key, base AS name, {_SLUG.format('base')} AS id FROM r WHERE k = 0")
def name_keep_first(spark, sf_dir):
    return _named(spark, sf_dir, "keep-first").drop("copy_index")


@query(f"WITH {_RANKED} SELECT channel_key, k AS copy_index, base AS name, {_SLUG.format('base')} AS id FROM r")
def name_none(spark, sf_dir):
    return _named(spark, sf_dir, "none")


@query(f"WITH {_RANKED} SELECT base AS base_name, feeds FROM r WHERE k = 0 AND feeds > 1")
def name_fail_conflicts(spark, sf_dir):
    return P.name_copies(P.collapse_feeds(grouped(spark, sf_dir)), "fail")[1]


@query(f"WITH {_RANKED}, n AS (SELECT channel_key, k AS copy_index, CASE WHEN k = 0 THEN base ELSE base || ' (' || source_id || ')' END AS want FROM r), m AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY channel_key, copy_index) AS i FROM n) SELECT channel_key, copy_index, CASE WHEN i = 1 THEN want ELSE want || ' ' || i END AS name FROM m")
def name_source(spark, sf_dir):
    return _named(spark, sf_dir, "source").drop("id")


@query(f"WITH {_RANKED} SELECT channel_key, k AS copy_index, CASE WHEN k = 0 THEN base ELSE base || '.' || (k + 1) END AS tvg_id FROM r")
def id_ordinals(spark, sf_dir):
    named, _ = P.name_copies(P.collapse_feeds(grouped(spark, sf_dir)), "backup")
    return P.finalise(named, "backup").select("channel_key", F.col("copy_index").cast("long").alias("copy_index"), "tvg_id")


@query("WITH u AS (SELECT p_partkey, 'http://h' || (p_partkey % 50) || '.tv/' || (p_partkey // 2) AS feed FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS k FROM u) SELECT p_partkey AS entry_id, feed FROM n WHERE k = 1")
def cross_group_dedupe(spark, sf_dir):
    from lumenloom.functions.text import normalize_stream_url

    e = entries(spark, sf_dir).withColumns({"channel_key": F.lpad(F.col("entry_id").cast("string"), 9, "0"), "copy_index": F.lit(0)})
    return P.drop_repeated_urls(e).select("entry_id", normalize_stream_url(F.col("url")).alias("feed"))


_BUILT = (
    "p AS (SELECT p_partkey AS k, upper(p_name) AS channel_key, p_name || ' ' || p_brand AS tvg, upper(p_type[1]) || lower(p_type[2:]) AS label, p_partkey % 3 AS source_order, p_partkey % 4 AS weight, p_size AS line FROM part), "
    "b AS (SELECT p.*, w.copy_no, 'http://h' || (k % 50) || '.tv/' || (k // 2) || w.mark AS feed FROM p JOIN (VALUES (0, ''), (1, 'a'), (2, 'b')) AS w(copy_no, mark) ON w.copy_no = 0 OR k % 9 = 0), "
    "c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY channel_key, feed ORDER BY k, copy_no) = 1), "
    "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY weight DESC, source_order, line, k, copy_no) - 1 AS copy_index FROM c) WHERE copy_index < 6), "
    "t AS (SELECT channel_key, arg_min(label, copy_index) AS best, arg_min(tvg, copy_index) AS base_name FROM m GROUP BY 1), "
    "l AS (SELECT channel_key, label, count(*) AS votes, min(k * 10 + copy_no) AS seen FROM m GROUP BY ALL), "
    "v AS (SELECT channel_key, label AS group_title, base_name FROM l JOIN t USING (channel_key) QUALIFY row_number() OVER (PARTITION BY channel_key ORDER BY votes DESC, label <> best, seen) = 1), "
    "n AS (SELECT m.*, v.group_title, v.base_name || CASE copy_index WHEN 0 THEN '' WHEN 1 THEN ' Backup' ELSE ' Backup ' || copy_index END AS name FROM m JOIN v USING (channel_key)), "
    "d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY feed ORDER BY channel_key, copy_index) = 1), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY lower(tvg) ORDER BY channel_key, copy_index) AS i FROM d)"
)


@query(f"WITH {_BUILT} SELECT channel_key, copy_index, regexp_replace(upper(name), '[^A-Z0-9]+', '.', 'g') || '.tr' AS id, name, tvg || CASE WHEN i > 1 THEN '.' || i ELSE '' END AS tvg_id, group_title, feed || '.m3u8' AS url FROM o")
def playlist_build(spark, sf_dir):
    """The whole flow over parts: a channel is a name, whatever brands it comes with."""
    out = P.build(entries(spark, sf_dir), P.PlaylistOptions()).entries
    return out.select("channel_key", F.col("copy_index").cast("long").alias("copy_index"), "id", "name", "tvg_id", "group_title", "url")


@query(
    f"WITH {_BUILT}, s AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM m) AS nm, (SELECT count(*) FROM n) AS nn, (SELECT count(*) FROM d) AS nd, (SELECT count(DISTINCT channel_key) FROM b) AS ng, (SELECT count(*) FROM b WHERE copy_no > 0) AS bb) "
    "SELECT np AS parsed, np AS selected, ng AS groups, bb AS backups_found, nb - nc AS collapsed_duplicates, nc - nm AS max_copies_dropped, nm - nn AS dropped_copies, nn - nd AS duplicate_urls_dropped, nd AS written FROM s"
)
def run_report(spark, sf_dir):
    return P.build(entries(spark, sf_dir), P.PlaylistOptions()).stats


#: Status, start of the body, error code, message; what they amount to.
PROBES = [
    (200, "#EXTM3U\n", None, None, None, False), (206, " #EXTM3U", "", "", None, False), (200, "<html>" + "x" * 400 + "#EXTM3U", None, None, "not-a-manifest", False), (403, "#EXTM3U", None, None, "forbidden", False),
    (404, "", None, None, "http-404", False), (429, "", None, None, "http-429", True), (503, "", None, None, "http-503", True), (301, "", None, None, "http-301", False), (None, None, "ENOTFOUND", "getaddrinfo", "enotfound", False),
    (None, None, "CERT_HAS_EXPIRED", "timeout", "cert_has_expired", False), (None, None, "", "self-signed in chain", "tls-error", False), (None, None, "ETIMEDOUT", "x", "timeout", True), (None, None, None, "The operation was aborted", "timeout", True),
    (None, None, "ECONNRESET", "read", "connection-reset", True), (None, None, None, "socket hang up", "connection-reset", True), (None, None, "EPIPE", "broken", "epipe", False), (500, None, None, "strange", "network-error", False),
]
_VERDICTS = ", ".join(f"({k}, {str(reason is None).lower()}, {'NULL' if reason is None else repr(reason)}, {str(again).lower()})" for k, (*_, reason, again) in enumerate(PROBES))


@query(f"WITH v(k, alive, reason, retryable) AS (VALUES {_VERDICTS}) SELECT event_id, alive, reason, retryable FROM events JOIN v ON event_id % {len(PROBES)} = k")
def liveness_classes(spark, sf_dir):
    """Every event is one of the recorded answers, among them misleading ones."""
    kinds = spark.createDataFrame([(k, *p[:4]) for k, p in enumerate(PROBES)], "k long, status int, body_head string, error_code string, error string")
    seen = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(PROBES)).alias("k")).join(F.broadcast(kinds), "k")  # as many rows as kinds
    return P.classify_probes(seen).select("event_id", "alive", "reason", "retryable")

"""Text and URL functions over ``part``, ``customer``, ``orders`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import instants as I
from lumenloom.functions import text as X
from lumenloom.plans.registry import query, table

_P = "p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part)"


@query("SELECT p_partkey, upper(replace(p_name, '.', '')) || '.tr' AS folded FROM part")
def fold_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.fold_channel_id(F.concat("p_name", F.lit(".tr"))).alias("folded"))


@query("SELECT p_partkey, trim(regexp_replace(upper(p_name || ' ' || p_brand), '[^A-Z0-9]+', '.', 'g'), '.') || '.tr' AS id FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.channel_id_from_name(F.concat_ws(" ", "p_name", "p_brand")).alias("id"))


@query("SELECT c_custkey, trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) AS normal FROM customer")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_name(F.col("c_name")).alias("normal"))


_TAGGED = "t AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' HD' WHEN 1 THEN ' (720p)' WHEN 2 THEN ' HD FHD' WHEN 3 THEN ' 4K' ELSE '' END AS name FROM part)"


def _tagged(spark, sf_dir):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " HD").when(k == 1, " (720p)").when(k == 2, " HD FHD").when(k == 3, " 4K").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("name"))


@query(f"WITH {_TAGGED} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN left(name, length(name) - 3) WHEN p_partkey % 5 = 2 THEN left(name, length(name) - 4) ELSE name END AS stripped FROM t")
def strip_quality(spark, sf_dir):
    return _tagged(spark, sf_dir).select("p_partkey", X.strip_quality_qualifier(F.col("name")).alias("stripped"))


@query(f"WITH {_TAGGED} SELECT p_partkey, upper(CASE WHEN p_partkey % 5 = 1 THEN left(name, length(name) - 7) ELSE name END) AS plain, upper(regexp_replace(regexp_replace(name, ' \\(720p\\)$', ''), '( HD| FHD)+$', '')) AS bare FROM t")
def strip_resolution(spark, sf_dir):
    name = F.col("name")
    return _tagged(spark, sf_dir).select("p_partkey", X.strip_resolution(name).alias("plain"), X.strip_quality_tokens(X.strip_resolution(name)).alias("bare"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE upper(p_name) END AS key FROM part")
def id_key(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.lit("ext")).when(k == 1, F.concat("p_name", F.lit(" HD.tr"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.id_key(raw).alias("key"))


@query("SELECT o_orderkey, upper(o_orderpriority[1]) || lower(o_orderpriority[2:2]) || CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'not Specified' ELSE lower(o_orderpriority[3:]) END AS title FROM orders")
def canonical_title(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.canonical_group_title(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("title"))


@query("SELECT page_id, 'http://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '\\.m3u8?$', '', 'i'), '/+$', '') AS feed FROM pages")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_stream_url(F.col("url")).alias("feed"))


@query("SELECT page_id, url || CASE WHEN contains(url, '#') THEN '' ELSE CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=REDACTED' END AS shown FROM pages")
def redact_url(spark, sf_dir):
    url = F.col("url")
    secret = F.when(F.contains(url, F.lit("#")), url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("token=abc123")))
    return table(spark, sf_dir, "pages").select("page_id", X.redact_url(secret).alias("shown"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_xml(F.col("html")).alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') = html AS same, html AS back FROM pages")
def entity_decode(spark, sf_dir):
    """Decoding undoes escaping."""
    escaped = X.escape_xml(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", (escaped == F.col("html")).alias("same"), X.decode_entities(escaped).alias("back"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw, len(regexp_extract_all(html, '<a href=\"')) AS links FROM pages")
def html_titles(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("raw"), F.regexp_count(html, F.lit('<a href="')).cast("long").alias("links"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^\\s|]+$') AS ok, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
def url_checks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.is_http_url(F.col("url")).alias("ok"), X.strip_query(F.col("url")).alias("bare"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Säsong ' || (event_id % 5) || ', Avsnitt ' || (event_id % 7) WHEN event_id % 3 = 1 THEN 'Avsnitt ' || (event_id % 7) ELSE 'Säsong ' || (event_id % 5) END AS label FROM events")
def episode_labels(spark, sf_dir):
    k = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", X.episode_label(F.when(k != 1, F.col("event_id") % 5), F.when(k != 2, F.col("event_id") % 7)).alias("label"))


#: Values and what comes of them, hostile ones among them; each customer is one of them.
FOLDED = [("Çığ İstanbul", "CIG ISTANBUL"), ("ﬁlm Âlem", "FILM ALEM"), ("ＡＢＣ１", "ABC1"), ("éß", "ÉSS"), (None, ""), ("plain", "PLAIN")]
PORTABLE = [("Şık  Kanal é..x", "sik.kanal.e.x"), ("--A_b:c--", "a_b:c"), ("ﬁ İı", "fi.ii"), ("!!", ""), (None, "")]
CONSUMER = [("a.b:c-d_1", True), ("-a", False), ("A", False), ("", False), ("x" * 128, True), ("x" * 129, False), (None, False)]
LANGUAGE = [("tr", True), (" en-US ", True), ("zh-Hant-TW", True), ("t", False), ("tr_TR", False), ("", False), (None, False)]
ABSOLUTE = [("http://x/a", "http://x/a"), ("//x/a", "https://x/a"), ("/a b", "https://b/a b"), ("a", "https://b/a"), (" ", None), (None, None)]
CLEAN = [("  a \n b ", "a b"), (" 　 ", None), ("", None), (None, None), ("x", "x")]
REDACTED = [
    ("http://u:p@h/x?Token=s3&b=1&app_id=9#f", "http://h/x?Token=REDACTED&b=1&app_id=REDACTED#f"), ("http://h/?%74oken=s", "http://h/?token=REDACTED"), ("not a url?token=x", "not a url?token=x"), ("http://h/?tokens=1&x=%zz", "http://h/?tokens=1&x=%zz"),
    ("http://h/a@b?q=u:p@z", "http://h/a@b?q=u:p@z"), ("https://h?access-token=1&pwd", "https://h?access-token=REDACTED&pwd=REDACTED"), (None, ""),
]
KEYS = [("ATV HD.tr", "atv", "ATV (720p)", "ATV"), ("ext", "Kanal D", "KANAL D FHD", "KANAL D|KANAL D FHD"), ("", "", "!!", ""), (None, None, "Şov UHD", "SOV UHD|SOV")]


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def _cases(cases: list[tuple]) -> str:
    """SQL that gives customers their case's result."""
    rows = ", ".join(f"({k}, {_literal(c[-1])})" for k, c in enumerate(cases))
    return f"WITH v(k, result) AS (VALUES {rows}) SELECT c_custkey, result FROM customer JOIN v ON c_custkey % {len(cases)} = k"


def _of(spark, sf_dir, cases: list[tuple], make):
    """Customers with ``make`` of their case's values; the cases are a list in the code."""
    names = [f"v{k}" for k in range(len(cases[0]) - 1)]
    given = spark.createDataFrame([(k, *c[:-1]) for k, c in enumerate(cases)], ", ".join(["k long", *[f"{n} string" for n in names]]))
    own = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(cases)).alias("k")).join(F.broadcast(given), "k")
    return own.select("c_custkey", make(*[F.col(n) for n in names]).alias("result"))


def _register(name: str, cases: list[tuple], make) -> None:
    def run(spark, sf_dir):
        return _of(spark, sf_dir, cases, make)

    run.__name__ = name
    query(_cases(cases))(run)


_register("fold_diacritics", FOLDED, X.fold_diacritics)
_register("portable_id", PORTABLE, X.to_portable_id)
_register("consumer_id", CONSUMER, X.is_consumer_id)
_register("language_tag", LANGUAGE, X.is_language_tag)
_register("absolute_url", ABSOLUTE, lambda x: X.absolutize(x, "https://b/"))
_register("clean_text", CLEAN, X.clean_text)
_register("redacted_urls", REDACTED, X.redact_url)
_register("channel_keys", KEYS, lambda a, b, c: F.array_join(X.channel_keys(a, b, c), "|"))

CLOCKS = [("0", "0", "0|0"), ("23", "59", "1439|1439"), ("24", "0", "|1440"), ("24", "1", "|"), ("12", "60", "|"), ("-1", "5", "|")]
REAL = [("2024", "2", "29", True), ("2023", "2", "29", False), ("2024", "13", "1", False), ("2024", "4", "31", False), ("2024", "12", "31", True)]
LENIENT = [("2026-09-08T15:00", "1788879600000"), ("2026-09-08T15:00:30.5Z", "1788879630500"), ("2026-09-08T15:00:00+0300", "1788868800000"), ("2026-09-08T15:00:00-23:59", "1788965940000"), ("2026-02-30T15:00Z", ""), ("2026-09-08 15:00", ""), ("2026-09-08T24:00Z", "")]
TURKISH = [("8 Eylül 2026 - Salı", "2026-09-08|"), ("01 Ocak 2020 ve 3 ŞUBAT 2021 tarihli", "2020-01-01|2021-02-03"), ("31 Nisan 2026 tarihli", "|"), ("1 Foo 2026 tarihli", "|"), (" 5 Ağustos 2026", "|"), ("15 KASIM 2026 tarihli x", "2026-11-15|2026-11-15")]
LISTS = [("a, b ,,c", "a|b|c"), (" ", ""), ("x", "x")]


def _int(x):
    return x.cast("int")


_register("clock_minutes", CLOCKS, lambda h, m: F.concat(F.coalesce(I.clock_minutes(_int(h), _int(m)).cast("string"), F.lit("")), F.lit("|"), F.coalesce(I.clock_minutes(_int(h), _int(m), True).cast("string"), F.lit(""))))
_register("real_dates", REAL, lambda y, m, d: I.is_real_date(_int(y), _int(m), _int(d)))
_register("lenient_instants", LENIENT, lambda x: F.coalesce(I.iso_epoch_ms(x).cast("long").cast("string"), F.lit("")))
_register("turkish_dates", TURKISH, lambda x: F.concat(*[p for b, a, end in (("^", "", "|"), ("", r"\s+tarihli", "")) for p in (F.coalesce(I.turkish_date(x, b, a).cast("string"), F.lit("")), F.lit(end))]))


@query("SELECT event_id, strftime(CAST(ts AS DATE), '%d-%m-%Y') AS dashed, CAST(CAST(ts AS DATE) - 1 AS VARCHAR) AS before, ['mo', 'tu', 'we', 'th', 'fr', 'sa', 'su'][isodow(ts)] AS weekday, CASE event_id % 4 WHEN 0 THEN 'bugun' WHEN 1 THEN 'yarin' WHEN 2 THEN 'sonraki-gun' END AS tag FROM events")
def date_slugs(spark, sf_dir):
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select("event_id", I.dashed_date(day).alias("dashed"), I.previous_day(day).cast("string").alias("before"), I.weekday_tag(day, ["mo", "tu", "we", "th", "fr", "sa", "su"]).alias("weekday"), I.day_tag(F.date_add(day, (F.col("event_id") % 4).cast("int")), day).alias("tag"))


@query("SELECT event_id, strftime(CAST(ts AS DATE) + CAST((event_id % 5000) // 1440 AS INTEGER), '%Y-%m-%dT') || lpad(CAST(event_id % 5000 % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 5000 % 60 AS VARCHAR), 2, '0') || ':00+03:00' AS at FROM events")
def rolling_minutes(spark, sf_dir):
    """Minutes beyond a day roll on to later days."""
    return table(spark, sf_dir, "events").select("event_id", I.wall_to_instant(F.to_date("ts"), F.col("event_id") % 5000).alias("at"))


@query("SELECT n_nationkey, CAST((current_timestamp AT TIME ZONE 'Europe/Istanbul')::DATE AS VARCHAR) AS today FROM nation")
def today_in_zone(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", I.today_in("Europe/Istanbul").cast("string").alias("today"))

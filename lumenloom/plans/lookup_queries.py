"""Lookups and date filters over ``part``, ``supplier``, ``nation``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.operators import lookup as L
from lumenloom.plans.registry import query, table


@query("WITH c AS (SELECT p_partkey, p_name AS name FROM part), t AS (SELECT upper(p_name) AS k, arg_min('c' || p_partkey || '.tr', p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT c.p_partkey, coalesce(t.id, lower(regexp_replace(upper(c.name), '[^A-Z0-9]+', '.', 'g')) || '.tr') AS id FROM c LEFT JOIN t ON upper(c.name) = t.k")
def curated_lookup(spark, sf_dir):
    """Every third part's name is curated; other names make their own id."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    curated = part.where("p_partkey % 3 = 0").select("name", F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit(".tr")).alias("id"), F.col("p_partkey").alias("ord"))
    return L.curated_ids(part, curated).select("p_partkey", F.lower("id").alias("id"))


@query("WITH t AS (SELECT 'NATION_' || n_nationkey AS k, 'n' || n_nationkey || '.tr' AS id, n_nationkey AS tv_id FROM nation WHERE n_nationkey % 2 = 0) SELECT s_suppkey, t.id, CAST(t.tv_id AS VARCHAR) AS tv_id FROM supplier LEFT JOIN t ON t.tv_id = s_nationkey")
def platform_lookup(spark, sf_dir):
    """Names match whatever quality words they carry on either side."""
    number = lambda c: F.concat(F.lit("nation_"), F.col(c).cast("string"))
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(number("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, " hd").otherwise("")).alias("name"))
    platform = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(number("n_nationkey"), F.lit(" 4K")).alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".tr")).alias("id"), F.col("n_nationkey").alias("tv_id"), F.col("n_nationkey").alias("ord"))
    return L.platform_ids(wanted, platform).select("s_suppkey", "id", F.col("tv_id").cast("string").alias("tv_id"))


_ASKED = "e AS (SELECT event_id, CAST(ts AS DATE) AS asked, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) + 1 END AS served FROM events)"


def _asked(spark, sf_dir):
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select("event_id", day.alias("asked"), F.when(F.col("event_id") % 3 == 0, day).when(F.col("event_id") % 3 == 1, F.date_add(day, 1)).alias("served"))


@query(f"WITH {_ASKED} SELECT event_id FROM e WHERE served = asked")
def served_date_strict(spark, sf_dir):
    return L.served_as_asked(_asked(spark, sf_dir)).select("event_id")


@query(f"WITH {_ASKED} SELECT event_id FROM e WHERE served = asked OR served IS NULL")
def served_date_lenient(spark, sf_dir):
    return L.served_as_asked(_asked(spark, sf_dir), unknown=True).select("event_id")


@query(f"WITH {_ASKED} SELECT event_id, CASE WHEN served <> asked THEN 'asked for ' || asked || ', served ' || served END AS warning FROM e")
def served_date_warned(spark, sf_dir):
    return L.served_with_warning(_asked(spark, sf_dir)).select("event_id", "warning")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM events GROUP BY 1 HAVING count(*) % 2 = 0)")
def clamp_dates(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"))
    dates = events.groupBy("date").count().where("count % 2 = 0")
    return L.in_dates(events, dates).select("event_id")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def exclude_owned(spark, sf_dir):
    owned = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return L.not_owned(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("id")), owned).select("s_suppkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN 'p' || (o_custkey % 7) END AS provider FROM orders")
def file_provider(spark, sf_dir):
    ident = F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string"))
    ends = F.element_at(F.array(F.lit("_TR.xml"), F.lit("_SE.xml.gz"), F.lit("_tr.xml"), F.lit(".xml")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.published_by(F.concat(F.lit("/guides/epg_"), ident, ends)).alias("provider"))

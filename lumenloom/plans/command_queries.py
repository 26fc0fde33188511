"""Limits, files and playlists as commands use them, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.operators import guide as G
from lumenloom.operators import lookup as L
from lumenloom.plans import guide_queries as Q
from lumenloom.plans.registry import query, table
from lumenloom.scratch import new_path
from lumenloom.sources import m3u, xmltv


@query(f"WITH {Q._PROGRAMMES} SELECT id, name FROM (SELECT row_number() OVER (ORDER BY provider, seq) AS n, id, name FROM c) WHERE n <= 40")
def channel_limit(spark, sf_dir):
    """At most forty channels are read: the limit is the feature."""
    return L.first_channels(Q.guide(spark, sf_dir).channels, 40).select("id", "name")


@query(f"WITH {Q._PROGRAMMES} SELECT count(*) AS channels, true AS packed FROM u")
def guide_file(spark, sf_dir):
    """A gzipped guide file: its size is told, and its channels come back."""
    path = new_path(spark, "guide")
    size = xmltv.write(G.merge(Q.guide(spark, sf_dir))[0], path)
    back = xmltv.read(spark, [path]).channels
    return back.agg(F.count("*").alias("channels")).withColumn("packed", F.lit(size > 20))


@query("SELECT 'sv' AS language, 'tr' AS otherwise, count(DISTINCT user_id) AS channels FROM events")
def guide_language(spark, sf_dir):
    """A guide says its language in its texts, and is Turkish if it says none."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit('<channel id="C'), F.col("user_id").cast("string"), F.lit('.tr"><display-name lang="?">x</display-name><display-name lang="sv">C &amp; ')).alias("a"))
    whole = ids.groupBy().agg(F.concat(F.lit("<tv>"), F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda a: F.concat(a, F.lit("</display-name></channel>"))), ""), F.lit("</tv>")).alias("value"))
    said = whole.select(F.lit(0).alias("provider"), F.replace("value", F.lit('<display-name lang="?">x</display-name>'), F.lit("")).alias("value"))
    guide, none = xmltv.parse(said), xmltv.parse(whole.select(F.lit(0).alias("provider"), "value"))
    return guide.channels.agg(F.count("*").alias("channels")).withColumns({"language": F.lit(guide.language), "otherwise": F.lit(none.language)})


@query("SELECT count(*) FILTER (p_partkey % 10 <> 1) AS parsed, count(*) FILTER (p_partkey % 10 = 1) AS missing_url, count(*) FILTER (p_partkey % 10 = 2) AS extra_urls, count(*) FILTER (p_partkey % 10 = 3) AS malformed, max(CASE WHEN p_partkey % 10 = 5 THEN 16384 ELSE 0 END) AS longest, CAST(count(*) FILTER (p_partkey % 10 = 4) AS BIGINT) AS regrouped FROM part")
def playlist_hostile(spark, sf_dir):
    """A playlist with entries that lack a URL or have two, unclosed quotes, groups of their own and fields beyond all bounds."""
    k, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 10
    url = F.concat(F.lit("\nhttp://h/"), k)
    tail = F.when(kind == 1, "").when(kind == 2, F.concat(url, url)).when(kind == 4, F.concat(F.lit("\n#EXTGRP: Own"), url)).otherwise(url)
    attrs = F.when(kind == 3, ' tvg-id="x tvg-name=y').when(kind == 5, F.concat(F.lit(' tvg-logo="'), F.repeat(F.lit("x"), 20_000), F.lit('"'))).otherwise(' tvg-id="i" group-title="G"')
    lines = table(spark, sf_dir, "part").select(F.struct("p_partkey", F.concat(F.lit("#EXTINF:-1"), attrs, F.lit(",Part "), k, tail).alias("x")).alias("s"))
    # every tenth part's line alone is 20,000 characters: a file for each 200 parts, so that files grow in number and not in size
    files = lines.groupBy(F.floor(F.col("s.p_partkey") / 200).alias("f")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "\n").alias("body"))
    entries, stats = m3u.parse(files.select(F.concat(F.lit("s"), F.col("f").cast("string")).alias("source_id"), F.col("f").cast("int").alias("source_order"), F.lit(0.0).alias("weight"), F.concat(F.lit("﻿#EXTM3U\r\n"), "body").alias("value")), max_bytes=10**9)
    counted = stats.agg(*[F.sum(c).cast("long").alias(c) for c in ("parsed", "missing_url", "extra_urls", "malformed")])
    return counted.crossJoin(entries.agg(F.max(F.length("tvg_logo")).alias("longest"), F.count_if(F.col("group_title") == "Own").alias("regrouped")))  # two one-row tables

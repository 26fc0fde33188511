"""Round trips through the file formats, over ``events`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.operators.guide import merge
from lumenloom.plans import guide_queries as Q
from lumenloom.plans import playlist_queries as PQ
from lumenloom.plans.registry import query
from lumenloom.scratch import new_path
from lumenloom.sources import m3u, xmltv


@query(f"WITH {Q._PROGRAMMES}, o AS (SELECT DISTINCT ON (spelling, start, stop) spelling AS channel, start, stop, title, \"desc\" FROM k ORDER BY spelling, start, stop, provider, seq) SELECT * FROM o")
def xmltv_roundtrip(spark, sf_dir):
    """Written and read back, the published slots of both providers' merged guide are the same."""
    path = new_path(spark, "guide")
    xmltv.write(merge(Q.guide(spark, sf_dir))[0], path)
    return xmltv.read(spark, [path]).programmes.select("channel", "start", "stop", "title", "desc")


@query("SELECT 'Part ' || p_partkey AS name, 'part' || p_partkey || '.tr' AS tvg_id, upper(p_type[1]) || lower(p_type[2:]) AS group_title, 'http://h.tv/' || p_partkey AS url FROM part")
def m3u_roundtrip(spark, sf_dir):
    """Written and read back, all entries are the same."""
    path = new_path(spark, "playlist")
    key = F.col("entry_id").cast("string")
    e = PQ.entries(spark, sf_dir).select(F.lpad(key, 12, "0").alias("channel_key"), F.lit(0).alias("copy_index"), F.concat(F.lit("Part "), key).alias("name"), F.concat(F.lit("part"), key, F.lit(".tr")).alias("tvg_id"), F.lit("").alias("tvg_name"), F.lit("").alias("logo"), "group_title", "attributes", "vlc_options", F.concat(F.lit("http://h.tv/"), key).alias("url"))
    m3u.write(e, path)
    # the reader's limits are for strangers' files; what was written here is read whole, however many parts there are
    return m3u.read(spark, [{"id": "a", "path": path}], max_bytes=0, max_entries=10**12)[0].select("name", "tvg_id", "group_title", "url")

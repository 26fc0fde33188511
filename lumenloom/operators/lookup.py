"""Lookups into curated tables, and filters by the date that a page serves.

Curated tables are data frames: Spark broadcasts one while it is under its size threshold and
shuffles on the key beyond that, so no size is assumed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text as X

_FILE = r"epg_([^/]+)_[A-Za-z]{2}\.xml(?:\.gz)?$"


def curated_ids(channels: DataFrame, curated: DataFrame, suffix: str = "tr") -> DataFrame:
    """``channels(name, ..)`` with ``id`` of ``curated(name, id)`` by normalised name, else one made from the name; of several curated rows of a name the one with the least ``ord``."""
    key = X.normalize_channel_key(F.col("name"))
    table = curated.groupBy(key.alias("_key")).agg(F.min_by("id", "ord").alias("_id"))
    joined = channels.withColumn("_key", key).join(table, "_key", "left")
    return joined.withColumn("id", F.coalesce("_id", X.channel_id_from_name(F.col("name"), suffix))).drop("_key", "_id")


def platform_key(name: Column) -> Column:
    """A name's key without the words HD and 4K."""
    return X.trim(F.regexp_replace(X.normalize_channel_key(name), r"\b(?:HD|4K)\b", ""))


def platform_ids(channels: DataFrame, platform: DataFrame) -> DataFrame:
    """``channels(name, ..)`` with ``id, tv_id`` of ``platform(name, id, tv_id, ord)`` whatever quality either name carries; null for strangers."""
    table = platform.groupBy(platform_key(F.col("name")).alias("_key")).agg(F.min_by(F.struct("id", "tv_id"), "ord").alias("_x"))
    joined = channels.withColumn("_key", platform_key(F.col("name"))).join(table, "_key", "left")
    return joined.withColumns({"id": F.col("_x.id"), "tv_id": F.col("_x.tv_id")}).drop("_key", "_x")


def served_as_asked(slots: DataFrame, unknown: bool = False) -> DataFrame:
    """Slots of pages whose ``served`` date is the one asked for, ``asked``; pages that don't say are kept if ``unknown``."""
    same = F.col("served") == F.col("asked")
    return slots.where(F.coalesce(same, F.lit(unknown)))


def served_with_warning(slots: DataFrame) -> DataFrame:
    """All slots, with ``warning`` on those of pages that say another date than the one asked for."""
    other = F.concat(F.lit("asked for "), F.col("asked").cast("string"), F.lit(", served "), F.col("served").cast("string"))
    return slots.withColumn("warning", F.when(F.col("served") != F.col("asked"), other))


def in_dates(slots: DataFrame, dates: DataFrame, column: str = "date") -> DataFrame:
    """Slots of the given dates."""
    return slots.join(dates.select(F.col("date").alias(column)).distinct(), column, "left_semi")


def not_owned(channels: DataFrame, owned: DataFrame) -> DataFrame:
    """Channels whose id no other provider owns; compared as written."""
    return channels.join(owned.select("id").distinct(), "id", "left_anti")


def published_by(file: Column) -> Column:
    """The provider in a guide file's name, null for other files."""
    return F.nullif(F.regexp_extract(file, _FILE, 1), F.lit(""))


def first_channels(channels: DataFrame, most: int) -> DataFrame:
    """At most so many channels, before anything is read for them."""
    return channels.orderBy("provider", "seq").limit(most)

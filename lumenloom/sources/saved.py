"""Guide sources over saved pages: a parser of ``sources.pages``, joined with what a file's name says.

A saved page's name carries its channel and day, as in ``trt1_2026-09-08.html``. Days outside the
window are pruned by name before any page is parsed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import instants as I
from lumenloom.functions import text as X
from lumenloom.operators import lookup as L
from lumenloom.operators.guide import OPTIONAL, Guide, derive_stops

NAME = r"([^/]+)_(\d{4}-\d{2}-\d{2})\.(?:html|json)(?:\.gz)?$"
_LISTED = "name string, id string, ord long"


@dataclass
class SavedPages:
    """Reads saved pages with ``parse(pages) -> slots``.

    Slots have either ``start`` and ``stop``, instants as text, or ``start_min``: then a slot ends
    where the channel's next one of the day begins, in the given offset. With ``served`` in the
    slots, pages that serve another day are left out, and so are those that don't say, unless
    ``unsaid`` is true. ``curated`` gives names their ids; other names make their own.
    """

    parse: Callable[[DataFrame], DataFrame]
    curated: dict[str, str] = field(default_factory=dict)
    suffix: str = "tr"
    offset: str = "+03:00"
    language: str = "tr"
    unsaid: bool = False
    name: str = NAME
    look_back: int = 0

    def pages(self, spark: SparkSession, paths: list[str], dates: list[dt.date]) -> DataFrame:
        """``page, value, channel, day`` of the window's pages, and of ``look_back`` days before it."""
        wanted = {d - dt.timedelta(k) for d in dates for k in range(self.look_back + 1)}
        path = F.input_file_name()
        files = spark.read.text(paths, wholetext=True).select(path.alias("page"), "value")
        named = files.withColumns({"channel": F.url_decode(F.replace(F.regexp_extract("page", self.name, 1), F.lit("+"), F.lit("%2B"))), "day": F.try_to_date(F.regexp_extract("page", self.name, 2), "yyyy-MM-dd")})
        return named.where(F.col("day").isin(sorted(wanted)))

    def read(self, spark: SparkSession, paths: list[str], dates: list[dt.date]) -> Guide:
        pages = self.pages(spark, paths, dates)
        about = pages.select("page", F.col("channel").alias("_name"), "day")
        slots = self.parse(pages).drop("channel", "day").join(about, "page").withColumn("channel", F.col("_name"))
        if "served" in slots.columns:
            slots = L.served_as_asked(slots.withColumn("asked", F.col("day")), self.unsaid)
        slots = slots.withColumn("seq", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 1_000_000 + F.col("seq"))
        if "start" not in slots.columns:
            timed = derive_stops(slots if "date" in slots.columns else slots.withColumn("date", F.col("day")))
            at = lambda c: I.wall_to_instant(F.col("date"), F.col(c), self.offset)
            slots = timed.withColumns({"start": at("start_min"), "stop": at("stop_min")})
        slots = slots.where(F.substring("start", 1, 10).isin([d.isoformat() for d in dates]))
        named = about.groupBy(F.col("_name").alias("name")).agg(F.min("day").alias("day"))
        curated = spark.createDataFrame([(n, i, k) for k, (n, i) in enumerate(self.curated.items())], _LISTED)
        listed = L.curated_ids(named, curated, self.suffix).select("name", X.fold_channel_id(F.col("id")).alias("id"))
        none = F.lit(None).cast("string")
        channels = listed.select(F.lit(0).alias("provider"), F.xxhash64("id").alias("seq"), "id", "name", none.alias("icon"), none.alias("url"))
        optional = [F.col(c) if c in slots.columns else none.alias(c) for c in OPTIONAL]
        programmes = slots.join(listed.select(F.col("name").alias("_name"), F.col("id").alias("_id")), "_name").select(F.lit(0).alias("provider"), "seq", F.col("_id").alias("channel"), "start", "stop", "title", *optional)
        return Guide(channels, programmes, days=len(dates), language=self.language)

"""Listing pages and API payloads: HTML by tokens, embedded JSON by schema.

Every parser takes ``pages(page, value)``, a whole document a row, and gives one row a slot or
channel with ``page`` and ``seq``, the place in the document. What is unsound is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.functions import instants as I
from lumenloom.functions import text as X
from lumenloom.operators.guide import least
from lumenloom.scratch import cut
from lumenloom.sources import markup as M
from lumenloom.sources import tokens as K


# Names of the parts of pages.
LIST, TIME, NAME = "epg-list", "time", "program-name"
PAIR_TIME, PAIR_NAME = "program-time", "program-name"
RAIL, ROW, CELL, CELL_TITLE, CELL_TIME = "flow-module-channel", "flow-module-row", "flow-module-col", "column-title", "column-time"
DAY_TITLE, DAY_ROW, DAY_TIME, DAY_NAME, BRAND = "day-title", "prog-row", "prog-time", "prog-name", "w-nav-brand"
SERVED_AFTER, CARD_LINK, LOGO_LINK = r"\s+tarihli", r"/([a-z0-9-]+)-yayin-akisi-bugun$", r"/yayin-akisi/([a-z0-9-]+)/\d{2}-\d{2}-\d{4}$"

_CLOCK = r"^(\d{1,2}):(\d{2})$"


def _made(rows: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """``kept`` and ``columns`` of ``rows``, worked out once a row. A condition on a plain column is checked before the column is made, which makes the column again wherever the condition names it; on an exploded one it is checked afterwards."""
    return rows.select(*kept, F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_r")).select(*kept, *[F.col(f"_r.{name}") for name in columns])


def _read(pages: DataFrame, **fields: Callable[[Column], Column]) -> DataFrame:
    """``page`` and what ``fields`` read from its tokens, once. Tokens stay inside one expression: as a column they would be packed, and unpacked whole for each section."""
    made = X.let(K.tokens(F.col("value")), lambda t: F.struct(*[f(t).alias(name) for name, f in fields.items()]))
    return _made(pages, "page", r=made).select("page", *[F.col(f"r.{name}") for name in fields])


def _each(pages: DataFrame, found: Callable[[Column], Column], fields: dict[str, Callable[[Column], Column]], **more: Callable[[Column], Column]) -> DataFrame:
    """A row for each section with what ``fields`` read from it; ``seq`` counts those of a page."""
    read = lambda t: F.transform(found(t), lambda s: F.struct(*[f(s).alias(name) for name, f in fields.items()]))
    return _rows(_read(pages, read=read, **more), "read", *more).select("page", *more, "seq", *[F.col(f"x.{name}") for name in fields])


def _rows(whole: DataFrame, read: str, *more: str, seq: str = "seq") -> DataFrame:
    """A row for each element of ``read``, as ``x``. The outer form keeps Spark from asking for the size of the array first, which would have it made twice."""
    return whole.select("page", *more, F.posexplode_outer(read).alias(seq, "x")).where(f"{seq} IS NOT NULL")


def _slots(rows: DataFrame, end_of_day: bool = True) -> DataFrame:
    """``rows(clock, title)`` with ``start_min``; rows without a time of day or a title are left out."""
    part = lambda k: F.regexp_extract("clock", _CLOCK, k).try_cast("int")
    start = X.let(F.struct(part(1).alias("h"), part(2).alias("m")), lambda p: I.clock_minutes(p["h"], p["m"], end_of_day))
    kept = [c for c in rows.columns if c not in ("clock", "title")]
    return _made(rows, *kept, title=F.col("title"), start_min=start).where("start_min IS NOT NULL AND title <> ''")


def _image(x: Column) -> Column:
    """The address if it is http(s) and has no ``|``."""
    return X.let(X.trim(x), lambda url: F.when(url.rlike("(?i)^https?://") & ~url.contains("|"), url))


def _clocked(clock: Callable[[Column], Column], title: Callable[[Column], Column]) -> dict[str, Callable[[Column], Column]]:
    return {"clock": lambda s: K.words(clock(s)), "title": lambda s: K.words(title(s))}


def flat_list(pages: DataFrame) -> DataFrame:
    """Slots of a page with one list of times and names, and the date that the page's title says it serves."""
    served = lambda t: I.turkish_date(K.words(K.element(t, "title")), after=SERVED_AFTER)
    items = lambda t: K.sections(K.element(t, "ul", LIST), ("li", None))
    rows = _each(pages, items, _clocked(lambda s: K.element(s, "div", TIME), lambda s: K.element(s, "div", NAME)), served=served)
    return _slots(rows, end_of_day=False)


def table_rows(pages: DataFrame) -> DataFrame:
    """Slots of a page with a table of names and times, and the date that begins its heading."""
    served = lambda t: I.turkish_date(K.words(K.element(t, "h2")), before="^")

    def cells(row: Column) -> Column:
        strong = F.filter(K.sections(row, ("td", None)), lambda c: F.exists(c, lambda t: t["name"] == "strong"))
        return F.transform(strong, lambda c: K.words(K.content(c)))

    rows = _each(pages, lambda t: K.sections(t, ("tr", None)), {"cells": cells}, served=served).where(F.size("cells") >= 2)
    return _slots(rows.select("page", "served", "seq", F.get("cells", F.lit(1)).alias("clock"), F.get("cells", F.lit(0)).alias("title")))


def table_logo(pages: DataFrame, base: str) -> DataFrame:
    """The address, without its query, of a page's first borderless image."""
    plain = lambda t: F.filter(K.sections(t, ("img", None)), lambda i: F.coalesce(K.raw_attribute(i, "border") == "0", F.lit(False)))
    found = _read(pages, src=lambda t: X.trim(K.raw_attribute(F.get(plain(t), F.lit(0)), "src")))
    sound = (F.col("src") != "") & ~F.col("src").startswith("data:") & ~F.col("src").rlike(r"[\s|]")
    return found.select("page", F.when(sound, X.strip_query(X.absolutize(F.col("src"), base))).alias("icon")).where("icon IS NOT NULL")


def zipped_lists(pages: DataFrame) -> DataFrame:
    """Slots of a page whose times and names stand beside each other in two series; the longer one's end is left out."""
    every = lambda tag, css: lambda t: F.transform(K.sections(t, (tag, css)), lambda s: K.words(K.content(s)))
    lists = _read(pages, times=every("strong", PAIR_TIME), names=every("p", PAIR_NAME))
    both = F.least(F.size("times"), F.size("names"))
    rows = _rows(lists.select("page", F.arrays_zip(F.slice("times", F.lit(1), both).alias("t"), F.slice("names", F.lit(1), both).alias("n")).alias("both")), "both")
    return _slots(rows.select("page", "seq", F.col("x.t").alias("clock"), F.col("x.n").alias("title")))


def _cards(pages: DataFrame, link: str, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Links whose address ends like ``link``: ``page, seq, slug`` and what ``fields`` read from the first image inside."""
    slug = lambda s: F.lower(F.regexp_extract(F.coalesce(K.attribute(s, "href"), F.lit("")), f"(?i){link}", 1))
    inside = lambda f: lambda s: K.let(K.first(K.content(s), "img"), f)
    return _each(pages, lambda t: K.sections(t, ("a", None)), {"slug": slug, **{name: inside(f) for name, f in fields.items()}}).where("slug <> ''")


def channel_cards(pages: DataFrame) -> DataFrame:
    """Channels of an index page; the first card of a slug that has a name counts."""
    icon = lambda i: _image(F.coalesce(K.attribute(i, "data-src"), K.attribute(i, "src")))
    named = _cards(pages, CARD_LINK, {"name": lambda i: X.collapse_whitespace(K.attribute(i, "alt")), "icon": icon})
    return least(named.where("name <> ''"), ["page", "slug"], ["seq"])


def logo_cards(pages: DataFrame) -> DataFrame:
    """Channel logos of an index page by slug; the first sound one counts."""
    sound = _cards(pages, LOGO_LINK, {"icon": lambda i: _image(K.attribute(i, "src"))}).where("icon IS NOT NULL")
    return sound.groupBy("page", "slug").agg(F.min_by("icon", "seq").alias("icon"))


def brand_logo(pages: DataFrame) -> DataFrame:
    """The logo in a page's brand link."""
    image = lambda t: K.first(K.element(t, "a", BRAND), "img")
    return _read(pages, icon=lambda t: _image(K.attribute(image(t), "src"))).where("icon IS NOT NULL")


def week_grid(pages: DataFrame, categories: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Channels of the rail and slots of the rows; row i belongs to the i-th channel. Equal times are a whole day, and a slot may cross midnight."""
    image = lambda name: lambda s: K.attribute(K.first(K.content(s), "img"), name)
    link = lambda s: K.attribute(K.first(K.content(s), "a"), "href")
    rail = lambda t: F.transform(K.sections(t, ("li", RAIL)), lambda s: F.struct(X.collapse_whitespace(image("alt")(s)).alias("name"), link(s).alias("url"), X.strip_query(image("src")(s)).alias("icon")))

    def cell(s: Column) -> Column:
        # the title ends where a link in it begins
        title = K.words(K.until(K.element(s, "h2", CELL_TITLE), "a"))
        shown = F.get(F.get(K.sections(s, (None, CELL_TIME)), F.lit(0)), F.lit(1))
        times = F.regexp_extract_all(F.when(shown["name"] == "", shown["raw"]), F.lit(r"(\d{1,2}:\d{2})"), F.lit(1))
        return F.struct(title.alias("title"), K.attribute(s, "data-type").alias("kind"), times.alias("times"))

    cells = lambda t: F.transform(K.sections(t, ("div", ROW)), lambda r: F.transform(K.sections(r, ("div", CELL)), cell))
    read = cut(_read(pages, rail=rail, cells=cells), "grids")  # a page is read once for both
    named = _rows(read, "rail").select("page", "seq", "x.*").where("name <> ''")
    channels = named.withColumn("channel_no", F.row_number().over(Window.partitionBy("page").orderBy("seq")) - 1)
    rows = _rows(read, "cells", seq="channel_no").withColumnRenamed("x", "row")
    found = _rows(rows, "row", "channel_no").select("page", "channel_no", "seq", "x.*").where(F.size("times") == 2)
    part = lambda k, n: F.split_part(F.get("times", F.lit(k)), F.lit(":"), F.lit(n)).try_cast("int")
    clocks = F.struct(part(0, 1).alias("h0"), part(0, 2).alias("m0"), part(1, 1).alias("h1"), part(1, 2).alias("m1"))
    ends = X.let(clocks, lambda c: F.struct(I.clock_minutes(c["h0"], c["m0"]).alias("start"), I.clock_minutes(c["h1"], c["m1"], True).alias("stop")))
    timed = _made(found, "page", "channel_no", "seq", "title", "kind", ends=ends)
    start, span = F.col("ends.start"), F.pmod(F.col("ends.stop") - F.col("ends.start"), F.lit(1440))
    category = F.try_element_at(F.create_map(*[F.lit(v) for kv in categories.items() for v in kv]), F.col("kind")) if categories else F.lit(None).cast("string")
    slots = timed.select("page", "channel_no", "seq", "title", category.alias("category"), start.alias("start_min"), (start + F.when(span == 0, 1440).otherwise(span)).alias("stop_min"))
    return channels, slots.where("title <> '' AND start_min IS NOT NULL AND stop_min IS NOT NULL")


def pair_rail(channels: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots with their channel's name, by position, and how many rows of each page have no channel."""
    paired = slots.join(channels.select("page", "channel_no", F.col("name").alias("channel")), ["page", "channel_no"], "left")
    lost = paired.where("channel IS NULL").groupBy("page").agg(F.count_distinct("channel_no").alias("unmatched_rows"))
    return paired.where("channel IS NOT NULL"), lost


def weekly_cards(pages: DataFrame) -> DataFrame:
    """Slots of a page of day headings (``name / DD.MM.YYYY``) and rows; a row belongs to the last sound heading before it.

    Headings and rows are sections of one series, so the order of what comes is its offset.
    """

    def day(s: Column) -> Column:
        own = lambda x: F.when(F.trim(F.substring_index(x, "/", 1)) != "", F.try_to_date(F.regexp_extract(x, r"/\s*(\d{2}\.\d{2}\.\d{4})$", 1), "dd.MM.yyyy"))
        return F.when(F.get(s, F.lit(0))["name"] == "h3", K.let(K.words(K.content(s)), own))

    of = lambda css: lambda s: K.element(s, "span", css)
    fields = {"day": day, "heading": lambda s: F.get(s, F.lit(0))["name"] == "h3", **_clocked(of(DAY_TIME), of(DAY_NAME))}
    both = _each(pages, lambda t: K.sections(t, ("h3", DAY_TITLE), ("div", DAY_ROW)), fields)
    w = Window.partitionBy("page").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = both.withColumn("date", F.last("day", ignorenulls=True).over(w)).where("NOT heading AND date IS NOT NULL")
    return _slots(dated.select("page", "seq", "date", "clock", "title"))


NEXT_DATA = "props struct<pageProps:struct<activeLeagues:array<struct<rewriteId:string,image:string,channelId:string>>,data:struct<event_date:string,listTvGuides:array<struct<channel_id:string,event_time:string,name:string>>>>>"


def _json(x: Column, schema: str) -> Column:
    return F.from_json(x, schema, {"mode": "PERMISSIVE"})


def next_data(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channels (first of an id) and slots of a page with its data in a script."""
    props = pages.select("page", _json(F.regexp_extract("value", r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), NEXT_DATA)["props"]["pageProps"].alias("p"))
    leagues = props.select("page", F.posexplode("p.activeLeagues").alias("seq", "x")).where("x.rewriteId <> '' AND x.channelId IS NOT NULL")
    channels = leagues.groupBy("page", F.col("x.rewriteId").alias("slug")).agg(F.min_by(F.col("x.channelId").try_cast("long"), "seq").alias("channel_id"), F.min_by(F.when(X.is_http_url(F.col("x.image")), F.col("x.image")), "seq").alias("icon"))
    items = props.select("page", F.try_to_date("p.data.event_date", "yyyy-MM-dd").alias("served"), F.posexplode("p.data.listTvGuides").alias("seq", "x"))
    clock = F.regexp_extract(X.trim(F.col("x.event_time")), r"^(\d{1,2}:\d{2})(?::\d{2})?$", 1)
    slots = items.select("page", "seq", "served", F.col("x.channel_id").try_cast("long").alias("channel_id"), clock.alias("clock"), M.words(F.col("x.name")).alias("title"))
    return channels, _slots(slots)


@F.pandas_udf(T.StringType())
def _balanced(x: pd.Series) -> pd.Series:
    """The JSON object that starts a text, by counting braces outside strings: no regular language."""
    import re

    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)

    def cut(text: str | None) -> str | None:
        depth = 0
        for m in token.finditer(text or ""):
            if m[0] == "{":
                depth += 1
            elif m[0] == "}":
                depth -= 1
                if depth == 0:
                    return text[: m.end()]
        return None

    return x.map(cut)


_EVENTS = "name string, date_time string, sport_name string, channels array<struct<name:string,icon:string>>"


def _event_slots(events: DataFrame) -> DataFrame:
    p = r"^(\d{4}-\d{2}-\d{2})[ T](\d{1,2}:\d{2})(?::\d{2})?$"
    at = X.trim(F.col("e.date_time"))
    rows = events.select("*", F.try_to_date(F.regexp_extract(at, p, 1), "yyyy-MM-dd").alias("date"), F.regexp_extract(at, p, 2).alias("clock"), M.words(F.col("e.name")).alias("title"), X.clean_text(F.col("e.sport_name")).alias("category")).drop("e")
    return _slots(rows.where("date IS NOT NULL"))


def state_events(pages: DataFrame) -> DataFrame:
    """Events of a page's state object that name the page's own channel (column ``channel``)."""
    after = F.substring_index(F.col("value"), "window.__INITIAL_STATE__=", -1)
    state = pages.where(F.contains("value", F.lit("window.__INITIAL_STATE__="))).select("page", "channel", _json(_balanced(after), f"common struct<events:array<struct<{_EVENTS.replace(' ', ':').replace(',:', ',')}>>>")["common"]["events"].alias("events"))
    events = state.select("page", "channel", F.posexplode("events").alias("seq", "e"))
    own = F.exists("e.channels", lambda c: X.normalize_channel_key(c["name"]) == X.normalize_channel_key(F.col("channel")))
    return _event_slots(events.where(own))


_BROADCAST = "array<struct<title:string,description:string,genres:array<struct<name:string>>,seasonNumber:int,episodeNumber:int,broadcast:struct<startTime:bigint,endTime:bigint>>>"


def state_schedule(pages: DataFrame, zone: str = "Europe/Stockholm") -> DataFrame:
    """Slots of a page whose state is JSON inside a JSON string, with both ends as epoch milliseconds."""
    quoted = F.regexp_extract("value", r'(?s)__INITIAL_STATE__\s*=\s*("(?:[^"\\]|\\.)*")', 1)
    inner = F.from_json(F.concat(F.lit('{"s":'), quoted, F.lit("}")), "s string")["s"]
    schedule = pages.select("page", _json(inner, f"schedule struct<id:string,name:string,slug:string,broadcasts:{_BROADCAST}>")["schedule"].alias("s"))
    rows = schedule.select("page", F.posexplode("s.broadcasts").alias("seq", "b"))
    start, stop = F.col("b.broadcast.startTime"), F.col("b.broadcast.endTime")
    genre = F.try_element_at(F.filter(F.transform("b.genres", lambda g: X.clean_text(g["name"])), lambda n: n.isNotNull()), F.lit(1))
    out = _made(rows, "page", "seq", start=I.epoch_to_iso(start, zone), stop=I.epoch_to_iso(stop, zone), date=F.to_date(I.local_wall(start, zone)), title=X.clean_text(F.col("b.title")), desc=X.clean_text(F.col("b.description")), category=genre, sub_title=X.episode_label(F.col("b.seasonNumber"), F.col("b.episodeNumber")), ok=stop > start)
    return out.where("ok AND title IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL").drop("ok")


def playbill(pages: DataFrame) -> DataFrame:
    """Slots of an API answer with explicit ends in UTC+03:00; other offsets are left out."""
    items = pages.select("page", F.posexplode(_json(F.col("value"), "playbilllist array<struct<starttime:string,endtime:string,name:string,genres:string>>")["playbilllist"]).alias("seq", "x"))
    p = r"^(\d{4}-\d{2}-\d{2}) (\d{1,2}):(\d{2})(?::\d{2})? UTC\+03:00$"

    def instant(x: Column) -> Column:
        part = lambda t, k: F.regexp_extract(t, p, k)
        parts = lambda t: F.when(t.rlike(p), F.struct(F.try_to_date(part(t, 1), "yyyy-MM-dd").alias("date"), part(t, 2).try_cast("int").alias("h"), part(t, 3).try_cast("int").alias("m")))
        return X.let(X.let(X.trim(x), parts), lambda w: X.let(I.clock_minutes(w["h"], w["m"], True), lambda m: I.wall_to_instant(w["date"], m)))

    rows = _made(items, "page", "seq", start=instant(F.col("x.starttime")), stop=instant(F.col("x.endtime")), title=X.trim(F.col("x.name")), category=X.let(X.trim(F.col("x.genres")), X.blank_to_null))
    return rows.where("title <> '' AND stop > start")


def channel_list_logos(pages: DataFrame) -> DataFrame:
    """A logo for each channel: the first sound address of the first picture kind that has one."""
    kinds = ["channelpic", "poster", "icon"]
    items = pages.select("page", F.posexplode(_json(F.col("value"), f"channellist array<struct<id:string,name:string,picture:struct<{','.join(k + ':string' for k in kinds)}>>>")["channellist"]).alias("seq", "x"))
    sound = lambda k: F.try_element_at(F.filter(F.transform(F.split(f"x.picture.{k}", ","), X.trim), lambda u: u.rlike("(?i)^https?://") & ~u.contains("|")), F.lit(1))
    rows = items.select("page", "seq", F.col("x.id").alias("id"), F.coalesce(*[sound(k) for k in kinds]).alias("icon")).where("id IS NOT NULL AND icon IS NOT NULL")
    return rows.groupBy("page", "id").agg(F.min_by("icon", "seq").alias("icon"))


def prevue(pages: DataFrame) -> DataFrame:
    """Slots of an API answer with explicit wall times ``YYYY.MM.DD HH:MM:SS``; reversed ones are left out."""
    items = pages.select("page", F.posexplode(_json(F.col("value"), "mobilPrevueViewModel array<struct<prevueName:string,genre:string,beginTime:string,endTime:string,description:string>>")["mobilPrevueViewModel"]).alias("seq", "x"))
    p = r"^(\d{4}\.\d{2}\.\d{2})\s+(\d{1,2}):(\d{2})(?::\d{2})?$"
    day = lambda c: F.try_to_date(F.regexp_extract(X.trim(F.col(c)), p, 1), "yyyy.MM.dd")
    minute = lambda c: I.clock_minutes(F.regexp_extract(X.trim(F.col(c)), p, 2).try_cast("int"), F.regexp_extract(X.trim(F.col(c)), p, 3).try_cast("int"), True)
    b, e = "x.beginTime", "x.endTime"
    rows = _made(items, "page", "seq", begin_date=day(b), begin_min=minute(b), end_date=day(e), end_min=minute(e), title=X.clean_text(F.col("x.prevueName")), category=X.let(X.trim(F.col("x.genre")), X.blank_to_null), desc=X.clean_text(F.col("x.description")))
    return rows.where("title IS NOT NULL AND begin_min IS NOT NULL AND end_min IS NOT NULL AND (end_date > begin_date OR end_date = begin_date AND end_min > begin_min)")


def event_envelope(pages: DataFrame, owners: dict[str, str]) -> DataFrame:
    """Slots of an API answer, one for each channel of an event that ``owners`` (normalised name to id) knows, if it falls on the page's ``day``."""
    events = pages.select("page", "day", F.posexplode(_json(F.col("value"), f"data array<struct<{_EVENTS.replace(' ', ':').replace(',:', ',')}>>")["data"]).alias("seq", "e"))
    known = F.create_map(*[F.lit(v) for kv in owners.items() for v in kv])
    fanned = events.select("page", "day", "seq", "e", F.explode("e.channels").alias("c")).withColumn("channel", F.try_element_at(known, X.normalize_channel_key(F.col("c.name")))).withColumn("icon", _image(F.col("c.icon"))).drop("c")
    return _event_slots(fanned.where("channel IS NOT NULL")).where(F.col("date") == F.col("day").cast("date"))


def platform_address(pages: DataFrame) -> DataFrame:
    """The secure address that an answer about the platform names; pages without one are left out."""
    return pages.select("page", F.nullif(F.get_json_object("value", "$.https"), F.lit("")).alias("https")).where("https IS NOT NULL")

"""Dates, wall times and instants that carry an offset.

Spark has no type for an instant with its offset, so such instants stay text, and the functions
here give their epoch seconds or lay them out anew. Impossible dates give null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three forms of an instant.
_GUIDE = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-](?:[01]\d|2[0-3]):[0-5]\d$"
_ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d)?(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?$"
_XMLTV = r"^\d{14}\s*[+-](?:[01]\d|2[0-3])[0-5]\d\z"

# Month names of Turkish pages, January first.
TURKISH_MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")


def _int(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, pattern, group).try_cast("int")


def is_real_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).isNotNull()


def clock_minutes(hours: Column, minutes: Column, end_of_day: bool = False) -> Column:
    ok = hours.between(0, 23) & minutes.between(0, 59)
    out = F.when(ok, hours * 60 + minutes)
    return F.when((hours == 24) & (minutes == 0), F.lit(1440)).otherwise(out) if end_of_day else out


def wall_to_instant(date: Column, minutes: Column, offset: str = "+03:00") -> Column:
    """Text of a wall time; minute 1440 is the next day's start, and later minutes roll on."""
    day = F.date_add(date, F.floor(minutes / 1440).cast("int"))
    m = F.pmod(minutes, F.lit(1440)).cast("int")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(f":00{offset}"))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` looks at it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _piece(x: Column, start: int, length: int) -> Column:
    return F.substring(x, start, length)


def _wall_seconds(date_and_time: Column) -> Column:
    """Seconds of ``YYYY-MM-DDTHH:MM:SS`` as if in UTC; null for an impossible date or time."""
    return F.unix_seconds(F.concat(date_and_time, F.lit("Z")).try_cast("timestamp"))


def _away_seconds(sign: Column, hours: Column, minutes: Column) -> Column:
    return (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60) * F.when(sign == "-", -1).otherwise(1)


def _guide_epoch(x: Column) -> Column:
    return F.when(x.rlike(_GUIDE), _wall_seconds(_piece(x, 1, 19)) - _away_seconds(_piece(x, 20, 1), _piece(x, 21, 2), _piece(x, 24, 2)))


def guide_epoch(x: Column) -> Column:
    """Epoch seconds of a strict instant ``YYYY-MM-DDTHH:MM:SS+HH:MM``; null for anything else."""
    return _bound(x, _guide_epoch)


def _iso_parts(x: Column) -> Column:
    """``wall`` with seconds, ``fraction`` as written, and ``away``, the offset as written, empty without one or for Z."""
    wall = F.concat(_piece(x, 1, 16), F.when(_piece(x, 17, 1) == ":", _piece(x, 17, 3)).otherwise(F.lit(":00")))
    return F.struct(wall.alias("wall"), F.regexp_extract(x, r"\.(\d+)", 1).alias("fraction"), F.regexp_extract(x, r"[+-]\d\d:?\d\d$", 0).alias("away"))


def _iso(x: Column, f: Callable[[Column], Column]) -> Column:
    return _bound(x, lambda t: F.when(t.rlike(_ISO), _bound(_iso_parts(t), f)))


def _iso_seconds(p: Column) -> Column:
    away = F.when(p["away"] == "", F.lit(0)).otherwise(_away_seconds(F.left(p["away"], F.lit(1)), F.substring(p["away"], 2, 2), F.right(p["away"], F.lit(2))))
    return _wall_seconds(p["wall"]) - away


def iso_epoch_ms(x: Column) -> Column:
    """Epoch milliseconds (double) of a wider ISO form: seconds, fraction and offset may be absent."""
    return _iso(x, lambda p: (_iso_seconds(p) + F.concat(F.lit("0."), p["fraction"], F.lit("0")).try_cast("double")) * 1000)


def to_xmltv(x: Column) -> Column:
    """``YYYYMMDDHHMMSS +HHMM``; null where the instant is impossible or has a fraction."""

    def laid_out(p: Column) -> Column:
        offset = F.when(p["away"] == "", F.lit("+0000")).otherwise(F.translate(p["away"], ":", ""))
        return F.when((p["fraction"] == "") & _iso_seconds(p).isNotNull(), F.concat(F.translate(p["wall"], "-T:", ""), F.lit(" "), offset))

    # a strict instant is laid out by its places, without the parts that other forms may lack
    strict = lambda t: F.when(_wall_seconds(_piece(t, 1, 19)).isNotNull(), F.concat(F.translate(_piece(t, 1, 19), "-T:", ""), F.lit(" "), F.translate(_piece(t, 20, 6), ":", "")))
    return _bound(x, lambda t: F.when(t.rlike(_GUIDE), strict(t)).otherwise(_iso(t, laid_out)))


def from_xmltv(x: Column) -> Column:
    """The strict instant of an XMLTV timestamp; null where it is malformed or impossible."""

    def instant(t: Column) -> Column:
        digits, away = [_piece(t, a, n) for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))], F.right(t, F.lit(5))
        y, mo, d, h, mi, s = digits
        return F.concat(F.concat_ws("-", y, mo, d), F.lit("T"), F.concat_ws(":", h, mi, s), F.left(away, F.lit(3)), F.lit(":"), F.right(away, F.lit(2)))

    sound = lambda i: F.when(_wall_seconds(_piece(i, 1, 19)).isNotNull(), i)
    return _bound(F.trim(x), lambda t: F.when(t.rlike(_XMLTV), _bound(instant(t), sound)))


def local_wall(ms: Column, zone: str) -> Column:
    """Wall-clock timestamp of epoch milliseconds in a zone; null outside 1970 to 2100."""
    return F.when(ms.between(0, 4102444800000), F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def zone_offset_minutes(ms: Column, zone: str) -> Column:
    return ((F.unix_seconds(local_wall(ms, zone)) - F.unix_seconds(F.timestamp_millis(ms))) / 60).cast("int")


def epoch_to_iso(ms: Column, zone: str) -> Column:
    """Instant text with the zone's offset at that time."""
    off = zone_offset_minutes(ms, zone)
    mark = F.concat(F.when(off < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.floor(F.abs(off) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(off) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local_wall(ms, zone), "yyyy-MM-dd'T'HH:mm:ss"), mark)


def turkish_date(x: Column, before: str = "", after: str = "") -> Column:
    """The first ``8 Eylül 2026`` in a text as a date. ``before``, ``after``: patterns of what must stand around it."""
    p = before + r"(\d{1,2})\s+(\p{L}+)\s+(\d{4})" + after

    def read(t: Column) -> Column:
        name = F.lower(F.replace(F.replace(F.regexp_extract(t, p, 2), F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))
        month = F.array_position(F.array(*[F.lit(m) for m in TURKISH_MONTHS]), name).cast("int")
        return _bound(month, lambda m: F.when(m > 0, F.try_make_timestamp(_int(t, p, 3), m, _int(t, p, 1), F.lit(0), F.lit(0), F.lit(0)).cast("date")))

    return _bound(x, read)


def date_window(anchor: Column, back: int, forward: int) -> Column:
    """All dates from ``back`` days before to ``forward`` days after."""
    return F.sequence(F.date_add(anchor, -back), F.date_add(anchor, forward))


def week_days(anchor: Column) -> Column:
    """Monday to Sunday of the anchor's week."""
    monday = F.date_trunc("week", anchor).cast("date")
    return F.sequence(monday, F.date_add(monday, 6))


def today_in(zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone))


def dashed_date(date: Column) -> Column:
    return F.date_format(date, "dd-MM-yyyy")


# How pages name the days around today, today first.
DAY_TAGS = ("bugun", "yarin", "sonraki-gun")


def day_tag(date: Column, today: Column) -> Column:
    """The tag of today and the two days after it, null for other days."""
    return F.get(F.array(*[F.lit(t) for t in DAY_TAGS]), F.datediff(date, today))


def previous_day(date: Column) -> Column:
    return F.date_sub(date, 1)


def weekday_tag(date: Column, tags: list[str]) -> Column:
    """Of seven tags, Monday's first, the date's."""
    return F.element_at(F.array(*[F.lit(t) for t in tags]), F.weekday(date) + 1)

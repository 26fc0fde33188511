"""Extended M3U playlists: a tolerant reader and a strict writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.operators.ranks import with_rank
from lumenloom.scratch import cut, drop
from lumenloom.sources import records as R

# Limits of the format's readers and writers, in bytes, entries and characters.
MAX_BYTES, MAX_ENTRIES, MAX_FIELD = 16 * 1024 * 1024, 20_000, 16_384
KEPT_ATTRIBUTES = ("tvg-id", "tvg-name", "tvg-logo", "group-title")

#: More lines than a playlist has: what tells sources' entries apart.
_LINES = 10**12

_PAIR = r'(?<![A-Za-z0-9_-])([A-Za-z0-9_-]*)="([^"]*)"'


def attributes(x: Column) -> Column:
    """``key="value"`` pairs: keys in lower case, the last of a key counts, values without quotes are passed over. The look-behind keeps the scan linear."""
    keys = F.transform(F.regexp_extract_all(x, F.lit(_PAIR), F.lit(1)), F.lower)
    pairs = F.arrays_zip(keys.alias("k"), F.regexp_extract_all(x, F.lit(_PAIR), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda p, i: (p["k"] != "") & ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.lit(0), F.size(keys) - i - 1)), p["k"]))
    return F.map_from_entries(last)


def unterminated(x: Column) -> Column:
    """Whether a quote is opened and not closed."""
    return F.regexp_replace(x, _PAIR, "").contains('="')


def _clamp(x: Column) -> Column:
    return F.substring(F.coalesce(x, F.lit("")), 1, MAX_FIELD)


_KEYS = ["source_id", "source_order", "weight"]
_BOM = "\ufeff"


def _numbered(lines: DataFrame, max_bytes: int) -> DataFrame:
    """Written ``lines`` that aren't blank, trimmed, with ``n``, their number in the source, ``rec``, how many entries begin up to them, and ``cut``, whether the source has more than ``max_bytes``.

    Counts run within a split; what the splits before it hold is added to them, a row a split. A
    byte order mark before the first line doesn't count, nor does the last line's end.
    """
    is_inf = F.col("l").startswith("#EXTINF")
    octets = F.octet_length("value") + 1
    counts = [F.count("*").alias("lines"), F.count_if("inf").alias("infs"), F.sum("octets").alias("bytes"), F.min_by(F.col("value").startswith(_BOM), "at").alias("bom")]
    own = lines.withColumn("l", X.trim(F.regexp_replace("value", f"^{_BOM}", ""))).withColumns({"inf": is_inf, "octets": octets.cast("long")})
    w = R.in_file_order(*_KEYS)
    upto = lambda c: F.sum(c).over(w) - F.col(c)
    total = F.sum("bytes").over(Window.partitionBy(*_KEYS))
    parts = R.splits(own, _KEYS, *counts).withColumns({"lines_0": upto("lines"), "infs_0": upto("infs"), "bytes_0": upto("bytes"), "total": total, "bom": F.first("bom").over(w)})
    parts = parts.select(*_KEYS, "file", "block", "first", "lines_0", "infs_0", "bytes_0", (F.col("total") - 1 - F.when(F.col("bom"), 3).otherwise(0)).alias("total"), F.when(F.col("bom"), 3).otherwise(0).alias("mark"))
    split = Window.partitionBy(*_KEYS, "file", "block").orderBy("at")
    counted = own.withColumns({"infs": F.sum(F.col("inf").cast("long")).over(split), "bytes": F.sum("octets").over(split) - F.col("octets")})
    out = counted.join(parts, [*_KEYS, "file", "block"]).withColumns({"n": F.col("lines_0") + F.col("at") - F.col("first"), "rec": F.col("infs_0") + F.col("infs"), "cut": F.lit(False)})
    if max_bytes:
        left = F.lit(max_bytes) - (F.col("bytes_0") + F.col("bytes") - F.col("mark"))
        ends = F.make_valid_utf8(F.substring(F.col("value").cast("binary"), F.lit(1), left.cast("int")).cast("string"))
        out = out.where(left > 0).withColumns({"cut": F.col("total") > max_bytes, "l": F.when(left < F.col("octets") - 1, X.trim(F.regexp_replace(ends, f"^{_BOM}", ""))).otherwise(F.col("l"))})
    return out.where("l <> ''").select(*_KEYS, "n", "rec", "cut", "l")


def _parse(lines: DataFrame, max_bytes: int, max_entries: int) -> tuple[DataFrame, DataFrame]:
    raw = cut(lines, "lines")  # places in the splits are what they were when it was written
    lines = _numbered(raw, max_bytes)
    is_inf, is_url = F.col("l").startswith("#EXTINF"), ~F.col("l").startswith("#")
    option, label = F.col("l").startswith("#EXTVLCOPT"), F.col("l").startswith("#EXTGRP")
    at_url = F.min(F.when(is_url, F.col("n"))).over(Window.partitionBy(*_KEYS, "rec"))
    lines = lines.where("rec > 0").withColumn("url_at", at_url)
    before = F.col("url_at").isNull() | (F.col("n") <= F.col("url_at"))
    records = lines.groupBy(*_KEYS, "rec").agg(
        F.max(F.when(is_inf, F.col("l"))).alias("inf"),
        F.max(F.when(is_inf, F.col("n"))).alias("n"),
        F.min_by("l", F.when(is_url, F.col("n"))).alias("url"),
        F.count_if(is_url).alias("urls"),
        F.max_by("l", F.when(label & before, F.col("n"))).alias("grp"),
        F.transform(F.sort_array(F.collect_list(F.when(option & before, F.struct("n", "l")))), lambda o: _clamp(F.substring(o["l"], len("#EXTVLCOPT:") + 1, 2**31 - 1))).alias("vlc_options"),
        F.bool_or("cut").alias("cut"),
    )
    records = cut(records, "entries")
    drop(raw)
    comma = F.col("inf").contains(",")
    attrs = F.when(comma, F.regexp_extract("inf", r"(?s)^#EXTINF(.*),[^,]*$", 1)).otherwise(F.substring("inf", len("#EXTINF") + 1, 2**31 - 1))
    records = records.withColumns({"_attrs": attrs, "name": F.when(comma, X.trim(F.regexp_extract("inf", r"(?s),([^,]*)$", 1))).otherwise("")})
    records = records.withColumn("attributes", attributes(F.col("_attrs")))
    pick = lambda k: _clamp(F.try_element_at("attributes", F.lit(k)))
    # an entry's place among its source's, without a task that sees all of them
    full = with_rank(records.where("url IS NOT NULL"), [*_KEYS, "rec"], "_place")
    heads = full.groupBy(*_KEYS).agg(F.min("_place").alias("_first"))
    kept = full.join(heads, _KEYS).where(F.col("_place") - F.col("_first") < max_entries)
    entries = kept.select(
        (F.col("source_order").cast("long") * _LINES + F.col("n")).alias("entry_id"), "source_id", "source_order", "weight", (F.col("n") + 1).alias("line"), _clamp(F.col("name")).alias("name"), pick("tvg-id").alias("tvg_id"), pick("tvg-name").alias("tvg_name"), pick("tvg-logo").alias("tvg_logo"),
        F.coalesce(F.when(F.col("grp").isNotNull(), _clamp(X.trim(F.substring("grp", len("#EXTGRP:") + 1, 2**31 - 1)))), pick("group-title")).alias("group_title"), "attributes", "vlc_options", _clamp(F.col("url")).alias("url"),
    )
    stats = records.groupBy("source_id", "source_order").agg(F.least(F.count("url"), F.lit(max_entries)).alias("parsed"), F.count_if(F.col("url").isNull()).alias("missing_url"), F.sum(F.greatest(F.lit(0), F.col("urls") - 1)).alias("extra_urls"), (F.count_if(~comma) + F.count_if(unterminated(F.col("_attrs")))).alias("malformed"), (F.bool_or("cut") | (F.count("url") > max_entries)).alias("truncated"))
    return entries, stats


def parse(files: DataFrame, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Entries and ``source_id, parsed, missing_url, extra_urls, malformed, truncated`` of ``files(source_id, source_order, weight, value)``, a whole file a row; ``max_bytes`` 0: all bytes."""
    return _parse(R.of_documents(files, "\n", *_KEYS), max_bytes, max_entries)


def read(spark: SparkSession, sources: list[dict], max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The same of the files in ``sources`` (``id``, ``path``, optional ``weight``), in order; files are read in splits, a line at a time, and folders as one file in parts."""
    about = spark.createDataFrame([(k, s["id"], k, float(s.get("weight") or 0)) for k, s in enumerate(sources)], "provider int, source_id string, source_order int, weight double")
    lines = R.read(spark, [s["path"] for s in sources], "\n").join(F.broadcast(about), "provider")  # as many rows as are named in the call
    return _parse(lines.select(*_KEYS, *R.WHERE, "value"), max_bytes, max_entries)


def validate(entries: DataFrame, shared_identity: bool = False) -> None:
    """Raise unless every name and URL is there, every URL is http(s), and names, ids and URLs are unique (names and ids only where they aren't shared on purpose)."""
    name, ident, url = F.lower(X.escape_display_name(F.col("name"))), F.nullif(F.lower(X.escape_attribute(F.col("tvg_id"))), F.lit("")), X.trim(F.coalesce("url", F.lit("")))
    found = entries.agg(
        F.count_if(name == "").alias("entries without a name"),
        F.count_if(ident == "ext").alias("entries with a placeholder as id"),
        F.count_if(~url.rlike(r"^(?i)https?://[^\s/]+")).alias("entries without an http(s) URL"),
        (F.count(url) - F.count_distinct(url)).alias("repeated URLs"),
        (F.count(name) - F.count_distinct(name)).alias("repeated names"),
        (F.count(ident) - F.count_distinct(ident)).alias("repeated ids"),
    ).first().asDict()
    if shared_identity:
        found["repeated names"] = found["repeated ids"] = 0
    if any(found.values()):
        raise ValueError("; ".join(f"{n} {what}" for what, n in found.items() if n))


def render(entries: DataFrame, keep: tuple[str, ...] = KEPT_ATTRIBUTES) -> DataFrame:
    """``entries`` (finalised) with ``value``, the lines of each."""
    values = {"tvg-id": F.col("tvg_id"), "tvg-name": F.col("tvg_name"), "tvg-logo": F.col("logo"), "group-title": X.canonical_group_title(F.col("group_title"))}
    shown = lambda k: X.escape_attribute(values[k] if k in values else F.try_element_at("attributes", F.lit(k)))
    pairs = F.concat_ws(" ", *[F.when(shown(k) != "", F.concat(F.lit(f'{k}="'), shown(k), F.lit('"'))) for k in keep])
    head = F.concat(F.when(pairs != "", F.concat(F.lit("#EXTINF:-1 "), pairs, F.lit(","))).otherwise("#EXTINF:-1,"), X.escape_display_name(F.col("name")))
    options = F.transform(F.filter(F.coalesce("vlc_options", F.array().cast("array<string>")), lambda o: X.escape_attribute(o) != ""), lambda o: F.concat(F.lit("#EXTVLCOPT:"), X.escape_attribute(o)))
    return entries.withColumn("value", F.array_join(F.concat(F.array(head), options, F.array(X.trim(F.col("url")))), "\n"))


def write(entries: DataFrame, path: str, keep: tuple[str, ...] = KEPT_ATTRIBUTES, shared_identity: bool = False, gzip: bool = False, whole: bool = True) -> None:
    """One playlist below ``path``, in one file or, if not ``whole``, in parts that ``read`` takes for it."""
    validate(entries, shared_identity)
    spark = entries.sparkSession
    head = spark.createDataFrame([("", -1, "#EXTM3U")], "channel_key string, copy_index int, value string")
    lines = cut(head.unionByName(render(entries, keep).select("channel_key", "copy_index", "value")), "lines")  # rendered once, then sorted by ranges
    R.write(lines, ["channel_key", "copy_index"], path, gzip, whole)
    drop(lines)

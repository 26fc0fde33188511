"""Playlist entries: selection, overrides, backups, channel groups, feeds, labels and names.

``entries``: entry_id (unique, in order of arrival), source_id, source_order, weight, line, name,
tvg_id, tvg_name, tvg_logo, group_title, attributes, vlc_options, url.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.operators.graph import components
from lumenloom.operators.guide import least
from lumenloom.operators.names import DOTTED, SPACED, unique_names, with_id_number
from lumenloom.scratch import cut

STYLES = ("numbered", "parenthesized", "none", "backup", "source", "keep-first", "fail")


@dataclass(frozen=True)
class Rule:
    """A declared group, id or name for what a glob matches; of several rules the first that matches counts."""

    pattern: str
    group: str | None = None
    id: str | None = None
    name: str | None = None


@dataclass
class PlaylistOptions:
    want: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    style: str = "backup"
    quality_tokens: tuple[str, ...] = X.QUALITY_TOKENS
    use_backups: bool = True
    dedupe_feeds: bool = True
    unify_groups: bool = True
    unify_scheme: bool = True
    keep_query: bool = False
    infer_id: bool = True
    id_suffix: str = "tr"
    max_copies: int = 6
    compatible: bool = True


def _forms(compatible: bool = True) -> Column:
    return X.selection_forms(F.col("tvg_id"), F.col("tvg_name"), F.col("name"), F.col("group_title"), compatible)


def select(entries: DataFrame, want: list[str], exclude: list[str], compatible: bool = True) -> tuple[DataFrame, DataFrame]:
    """The wanted entries that aren't excluded, and ``pattern`` for each wanted glob that none of them met. Without wants everything is wanted."""
    want, exclude = [p for p in want if p], [p for p in exclude if p]
    formed = entries.withColumn("_forms", _forms(compatible))
    left = formed.where(~X.matches_any(F.col("_forms"), exclude)) if exclude else formed
    kept = (left.where(X.matches_any(F.col("_forms"), want)) if want else left).drop("_forms")
    spark = entries.sparkSession
    if not want:
        return kept, spark.createDataFrame([], "pattern string")
    hits = left.agg(F.array(*[F.coalesce(F.bool_or(X.matches_any(F.col("_forms"), [p])), F.lit(False)) for p in want]).alias("hit"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in want]).alias("pattern"), F.col("hit"))
    return kept, hits.select(F.explode(pairs).alias("x")).where("NOT x.hit").select(F.col("x.pattern").alias("pattern"))


def _first_rule(forms: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """A chain of conditions in the rules' order: no join, and the first match counts."""
    if not rules:
        return otherwise
    head, *rest = rules
    return reduce(lambda c, r: c.when(X.matches_any(forms, [r[0]]), F.lit(r[1])), rest, F.when(X.matches_any(forms, [head[0]]), F.lit(head[1]))).otherwise(otherwise)


def override(entries: DataFrame, rules: list[Rule], compatible: bool = True) -> DataFrame:
    """Declared groups, then declared ids and names. Labels without a rule get their canonical spelling."""
    named = entries.withColumn("group_title", X.canonical_group_title(F.col("group_title")))
    groups = [(r.pattern, r.group) for r in rules if r.group]
    if groups:
        titles = [(p, g) for p, g in groups]
        formed = named.withColumn("_forms", _forms(compatible))
        named = formed.withColumn("group_title", X.canonical_group_title(_first_rule(F.col("_forms"), titles, F.col("group_title")))).drop("_forms")
    pinned = [r for r in rules if r.id or r.name]
    if not pinned:
        return named
    formed = named.withColumn("_forms", _forms(compatible))
    which = _first_rule(F.col("_forms"), [(r.pattern, str(k)) for k, r in enumerate(pinned)], F.lit(None).cast("string"))
    formed = formed.withColumn("_rule", which)
    pick = lambda attr: F.try_element_at(F.create_map(*[F.lit(v) for k, r in enumerate(pinned) for v in (str(k), getattr(r, attr))]), F.col("_rule"))
    ids, names = (pick("id") if any(r.id for r in pinned) else F.lit(None)), (pick("name") if any(r.name for r in pinned) else F.lit(None))
    return formed.withColumns({"tvg_id": F.coalesce(ids, "tvg_id"), "tvg_name": F.coalesce(names, "tvg_name"), "name": F.coalesce(names, "name")}).drop("_forms", "_rule")


def expand_backups(entries: DataFrame, enabled: bool = True) -> DataFrame:
    """Each entry and, after it, a copy for each declared backup URL (``yedek``, ``yedek2``, ..), by number; blank and repeated URLs are left out. Copies carry no attributes or options."""
    base = entries.withColumns({"copy_no": F.lit(0), "backup_of": F.lit(None).cast("string")})
    if not enabled:
        return base
    url = X.trim(F.coalesce("url", F.lit("")))
    declared = F.map_entries(F.map_filter("attributes", lambda k, v: k.rlike(r"(?i)^yedek\d*$")))
    keyed = F.array_sort(F.transform(declared, lambda e, i: F.struct(F.coalesce(F.regexp_replace(e["key"], r"\D", "").try_cast("long"), F.lit(0)).alias("n"), i.alias("i"), e["key"].alias("key"), X.trim(e["value"]).alias("url"))))
    withurls = entries.withColumn("_b", F.filter(keyed, lambda e: (e["url"] != "") & (e["url"] != url)))
    first = F.filter("_b", lambda e, i: F.array_position(F.transform("_b", lambda x: x["url"]), e["url"]) == i + 1)
    copies = withurls.select("*", F.posexplode(first).alias("_p", "_e")).withColumns({"url": F.col("_e.url"), "copy_no": F.col("_p") + 1, "backup_of": F.col("_e.key"), "attributes": F.create_map().cast("map<string,string>"), "vlc_options": F.array().cast("array<string>")})
    return base.unionByName(copies.drop("_b", "_p", "_e"))


def group_channels(entries: DataFrame, tokens=X.QUALITY_TOKENS, compatible: bool = True) -> DataFrame:
    """``entries`` with ``group_id``, the least of all keys that any entry of the channel has, and ``group_seq``, the channel's first entry.

    Entries that share a key are one channel, over any number of steps. The edges run from each
    entry's least key to its others, so the graph has keys only and no entry appears in it; an
    entry without a key is a channel of its own.
    """
    keyed = entries.withColumn("_keys", X.channel_keys(F.col("tvg_id"), F.col("tvg_name"), F.col("name"), tokens, compatible))
    edges = keyed.select(F.array_min("_keys").alias("a"), F.explode("_keys").alias("b")).where("a <> b").distinct()
    labels = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    mine = keyed.withColumn("_key", F.array_min("_keys")).join(labels.withColumnsRenamed({"node": "_key"}), "_key", "left")
    out = mine.withColumn("group_id", F.coalesce("label", "_key", F.lit("")))
    own = F.when(F.col("group_id") == "", F.concat(F.lit("\x00"), F.lpad(F.col("entry_id").cast("string"), 20, "0"))).otherwise(F.col("group_id"))
    return out.withColumn("channel_key", own).drop("_keys", "_key", "label")


def _rank() -> list[Column]:
    """Weight first, then the sources' order, the line, and arrival."""
    return [F.coalesce("weight", F.lit(0.0)).desc(), F.col("source_order"), F.coalesce("line", F.lit(0)), F.col("entry_id"), F.col("copy_no")]


def rank_copies(entries: DataFrame) -> DataFrame:
    """``entries`` with ``copy_index`` within the channel, 0 for the best."""
    return entries.withColumn("copy_index", F.row_number().over(Window.partitionBy("channel_key").orderBy(*_rank())) - 1)


def collapse_feeds(entries: DataFrame, unify_scheme: bool = True, keep_query: bool = False) -> DataFrame:
    """Of a channel's entries with the same feed the first seen."""
    feed = X.normalize_stream_url(F.col("url"), unify_scheme, keep_query)
    return least(entries.withColumn("_feed", feed), ["channel_key", "_feed"], ["entry_id", "copy_no"]).drop("_feed")


def cap_copies(entries: DataFrame, most: int, ranked: bool = True) -> DataFrame:
    """At most so many copies of a channel, the best; 0 keeps all. ``ranked`` False: the first that came."""
    if most <= 0:
        return entries
    order = _rank() if ranked else [F.col("entry_id"), F.col("copy_no")]
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy("channel_key").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def vote_labels(entries: DataFrame) -> DataFrame:
    """The group title that most copies of a channel carry: real labels before placeholders, the best copy's label on a tie, else the first seen."""
    marked = entries.withColumn("_label", X.canonical_group_title(F.col("group_title")))
    best = F.min_by("_label", F.struct(-F.coalesce("weight", F.lit(0.0)), "source_order", F.coalesce("line", F.lit(0)), "entry_id", "copy_no"))
    base = marked.groupBy("channel_key").agg(best.alias("_base"))
    counts = marked.groupBy("channel_key", "_label").agg(F.count("*").alias("n"), F.min(F.struct("entry_id", "copy_no")).alias("seen")).join(base, "channel_key")
    order = F.struct(X.is_placeholder_label(F.col("_label")).alias("p"), (-F.col("n")).alias("n"), (F.col("_label") != F.col("_base")).alias("b"), "seen")
    winner = counts.groupBy("channel_key").agg(F.min_by("_label", order).alias("_winner"))
    return marked.join(winner, "channel_key").withColumn("group_title", F.col("_winner")).drop("_label", "_winner")


def name_copies(entries: DataFrame, style: str = "backup", suffix: str = "tr") -> tuple[DataFrame, DataFrame]:
    """``entries`` with ``base_name, copy_index, id`` and the name that the style gives, and ``base_name, feeds`` of channels in conflict (style ``fail`` only).

    Candidate names and ids that are taken get the next free number, in output order. The rows
    are written once; names and ids are found over their keys alone and joined to them at the end.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; known are {', '.join(STYLES)}")
    w = Window.partitionBy("channel_key").orderBy(*_rank())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = X.base_display_name(F.col("tvg_name"), F.col("name"))
    declared = F.first(F.nullif(X.trim(F.coalesce("tvg_id", F.lit(""))), F.lit("")), ignorenulls=True).over(whole)
    out = entries.withColumns({"copy_index": F.row_number().over(w) - 1, "base_name": F.first(base).over(whole), "_declared": declared, "_feeds": F.count("*").over(whole)})
    out = cut(out, "copies")
    conflicts = out.where("copy_index = 0 AND _feeds > 1").select("base_name", F.col("_feeds").alias("feeds")) if style == "fail" else out.limit(0).select("base_name", F.col("_feeds").alias("feeds"))
    if style == "fail":
        out = out.where("_feeds = 1")
    if style == "keep-first":
        out = out.where("copy_index = 0")
    b, k = F.col("base_name"), F.col("copy_index")
    later = {
        "backup": F.when(k == 1, F.concat(b, F.lit(" Backup"))).otherwise(F.concat(b, F.lit(" Backup "), k.cast("string"))),
        "parenthesized": F.concat(b, F.lit(" ("), k.cast("string"), F.lit(")")),
        "source": F.concat(b, F.lit(" ("), F.coalesce(F.nullif("source_id", F.lit("")), F.lit("unknown")), F.lit(")")),
        "numbered": F.concat(b, F.lit(" B"), (k + 1).cast("string")),
    }
    name = b if style in ("none", "keep-first") else F.when(k == 0, b).otherwise(later.get(style, b))
    if style == "none":
        heads = out.where("copy_index = 0").select("channel_key", "copy_index", F.coalesce("_declared", X.channel_id_from_name(b, suffix)).alias("_want"))
        ids = unique_names(heads, "_want", DOTTED, "id").select("channel_key", "id")
        shared = out.join(ids, "channel_key")
        return shared.withColumns({"name": b, "tvg_name": b, "tvg_id": F.col("id")}).drop("_declared", "_feeds"), conflicts
    key = ["channel_key", "copy_index"]
    kept = F.when((k == 0) & F.col("_declared").isNotNull(), F.col("_declared"))
    names = unique_names(out.select(*key, name.alias("_want"), kept.alias("_kept")), "_want", SPACED, "name").select(*key, "_kept", "name")
    want = names.select(*key, "name", F.coalesce("_kept", X.channel_id_from_name(F.col("name"), suffix)).alias("_want"))
    ids = unique_names(want, "_want", DOTTED, "id").select(*key, "name", "id")
    return out.drop("name", "_declared", "_feeds").join(ids, key), conflicts


def drop_repeated_urls(entries: DataFrame, unify_scheme: bool = True) -> DataFrame:
    """Of all channels' entries with the same feed, query included, the first in output order."""
    feed = X.normalize_stream_url(F.col("url"), unify_scheme, True)
    return least(entries.withColumn("_feed", feed), ["_feed"], ["channel_key", "copy_index"]).drop("_feed")


def finalise(entries: DataFrame, style: str, infer: bool = True) -> DataFrame:
    """Emitted entries: the declared id, else one from the base name; repeats of an id get their number, unless the style shares ids on purpose."""
    raw = X.trim(F.coalesce("tvg_id", F.lit("")))
    own = F.when(F.lower(raw) != "ext", F.nullif(raw, F.lit("")))
    inferred = F.coalesce(F.nullif(X.trim(F.coalesce("tvg_name", F.lit(""))), F.lit("")), F.nullif(X.trim(F.coalesce("base_name", F.lit(""))), F.lit("")))
    out = entries.withColumn("_id", F.coalesce(own, inferred if infer else F.lit(None), F.lit("")))
    if style != "none":
        # blank ids get no number, so they needn't meet in one task
        apart = F.when(F.col("_id") == "", F.xxhash64("channel_key", "copy_index"))
        n = F.row_number().over(Window.partitionBy(F.lower("_id"), apart).orderBy("channel_key", "copy_index"))
        out = out.withColumn("_k", n).withColumn("_id", F.when((F.col("_k") > 1) & (F.col("_id") != ""), with_id_number(F.col("_id"), F.col("_k"))).otherwise(F.col("_id"))).drop("_k")
    return out.select("channel_key", "copy_index", "id", "name", F.col("_id").alias("tvg_id"), F.coalesce("tvg_name", F.lit("")).alias("tvg_name"), F.coalesce("tvg_logo", F.lit("")).alias("logo"), X.canonical_group_title(F.col("group_title")).alias("group_title"), "url", "vlc_options", "attributes", "source_id", "base_name")


@dataclass
class Playlist:
    entries: DataFrame
    stats: DataFrame
    unmatched: DataFrame
    conflicts: DataFrame


def build(entries: DataFrame, options: PlaylistOptions | None = None) -> Playlist:
    """The whole flow, in its fixed order: select, override, expand, group, collapse, cap, vote, name, drop repeated URLs, finalise."""
    o = options or PlaylistOptions()
    kept, unmatched = select(entries, o.want, o.exclude, o.compatible)
    expanded = expand_backups(override(kept, o.rules, o.compatible), o.use_backups)
    grouped = cut(group_channels(expanded, o.quality_tokens, o.compatible), "grouped")
    collapsed = collapse_feeds(grouped, o.unify_scheme, o.keep_query) if o.dedupe_feeds else grouped
    capped = cap_copies(collapsed, o.max_copies, o.dedupe_feeds)
    named, conflicts = name_copies(vote_labels(capped) if o.unify_groups else capped, o.style, o.id_suffix)
    named = cut(named, "named")
    unique = drop_repeated_urls(named, o.unify_scheme)
    out = finalise(unique, o.style, o.infer_id)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    tables = [n(entries, "parsed"), n(kept, "selected"), grouped.agg(F.count_distinct("channel_key").alias("groups"), F.count_if(F.col("copy_no") > 0).alias("backups")), n(collapsed, "collapsed"), n(capped, "capped"), n(named, "named"), n(out, "written")]
    stats = reduce(lambda a, b: a.crossJoin(b), tables)  # one-row tables
    found = grouped.agg(F.count("*").alias("grouped"))
    stats = stats.crossJoin(found).select("parsed", "selected", "groups", F.col("backups").alias("backups_found"), (F.col("grouped") - F.col("collapsed")).alias("collapsed_duplicates"), (F.col("collapsed") - F.col("capped")).alias("max_copies_dropped"), (F.col("capped") - F.col("named")).alias("dropped_copies"), (F.col("named") - F.col("written")).alias("duplicate_urls_dropped"), "written")
    return Playlist(out, stats, unmatched, conflicts)


def report(playlist: Playlist) -> str:
    """The run as JSON, URLs redacted."""
    rows = playlist.entries.orderBy("channel_key", "copy_index").select("name", "tvg_id", "source_id", "copy_index", X.redact_url(F.col("url")).alias("url")).toLocalIterator()
    return json.dumps({"stats": playlist.stats.first().asDict(), "unmatched_patterns": [r.pattern for r in playlist.unmatched.collect()], "conflicts": [f"{r.base_name} ({r.feeds} feeds)" for r in playlist.conflicts.collect()], "entries": [r.asDict() for r in rows]}, ensure_ascii=False)


# Transport errors that trying again doesn't mend.
FINAL_ERRORS = ("ECONNREFUSED", "ENOTFOUND", "EAI_AGAIN", "CERT_HAS_EXPIRED", "ERR_TLS_CERT_ALTNAME_INVALID", "DEPTH_ZERO_SELF_SIGNED_CERT", "UNABLE_TO_VERIFY_LEAF_SIGNATURE")


def classify_probes(observations: DataFrame) -> DataFrame:
    """``observations(url, status, body_head, error_code, error)`` with ``alive, reason, retryable``.

    Alive is a 2xx answer that holds ``#EXTM3U`` in its first 400 characters. A transport error
    (a code or a message) counts before a status. Timeouts, resets, 429 and 5xx are worth another try.
    """
    code, message = F.upper(F.coalesce("error_code", F.lit(""))), F.coalesce("error", F.lit(""))
    status, failed = F.coalesce("status", F.lit(0)), (F.coalesce("error_code", F.lit("")) != "") | (F.coalesce("error", F.lit("")) != "")
    manifest = F.contains(F.substring(F.coalesce("body_head", F.lit("")), 1, 400), F.lit("#EXTM3U"))
    transport = (
        F.when(code.isin(*FINAL_ERRORS), F.lower(code))
        .when(message.rlike("(?i)certificate|self.signed|SSL|TLS"), "tls-error")
        .when((code == "ETIMEDOUT") | message.rlike("(?i)abort|timed? ?out"), "timeout")
        .when((code == "ECONNRESET") | message.rlike("(?i)socket hang up|reset"), "connection-reset")
        .when(code != "", F.lower(code))
        .otherwise("network-error")
    )
    answered = F.when(status.between(200, 299), F.when(~manifest, "not-a-manifest")).when(status == 403, "forbidden").otherwise(F.concat(F.lit("http-"), status.cast("string")))
    out = observations.withColumn("reason", F.when(failed, transport).otherwise(answered))
    again = F.when(failed, F.col("reason").isin("timeout", "connection-reset")).otherwise((status == 429) | status.between(500, 599))
    return out.withColumns({"alive": F.col("reason").isNull(), "retryable": again})

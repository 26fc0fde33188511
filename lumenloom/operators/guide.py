"""Guides: channels and programme slots of one or many providers.

A guide is a pair of DataFrames:

    channels    provider, seq, id, name, icon, url
    programmes  provider, seq, channel, start, stop, title, sub_title, desc, category, icon

``provider`` is the order of precedence and ``seq`` the order within a provider, both taken from
the data. "First wins" always means least ``(provider, seq)``. Instants stay text; comparisons of
time use their epoch seconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import instants as I
from lumenloom.functions import text as X
from lumenloom.operators.ranks import with_rank
from lumenloom.scratch import cut

OPTIONAL = ["sub_title", "desc", "category", "icon"]
IDENTITY = ["channel", "start", "stop", "title"]
SLOT = ["channel", "start", "stop"]


@dataclass
class Guide:
    channels: DataFrame
    programmes: DataFrame
    days: int = 0
    failures: int = 0
    language: str = "tr"
    #: Languages of the guides that this one holds, in order of precedence, where they are known.
    languages: tuple[str, ...] = ()


def derive_stops(slots: DataFrame) -> DataFrame:
    """``slots(channel, date, start_min, seq, ..)`` with ``stop_min``: the next start of the day, or midnight. Of equal starts the last survives, and a start at 24:00 gives nothing."""
    w = Window.partitionBy("channel", "date").orderBy("start_min", "seq")
    return slots.withColumn("stop_min", F.lead("start_min", 1, 1440).over(w)).where("stop_min > start_min")


def derive_stops_by_title(slots: DataFrame) -> DataFrame:
    """As ``derive_stops``, with equal starts in the titles' dictionary order."""
    w = Window.partitionBy("channel", "date").orderBy("start_min", F.collate("title", "UNICODE"), "seq")
    return slots.withColumn("stop_min", F.lead("start_min", 1, 1440).over(w)).where("stop_min > start_min")


def chain_stops(slots: DataFrame) -> DataFrame:
    """``slots`` with ``stop_at``, in minutes since 1970: the channel's next start on this or any later day, or its own day's end after the last.

    Days are chained through one row a channel and day, so a busy channel's slots are never in
    one window together.
    """
    at = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 1440
    own = Window.partitionBy("channel", "date").orderBy("start_min", "seq")
    days = slots.groupBy("channel", "date").agg(F.min("start_min").alias("first_min"))
    days = days.withColumn("next_at", F.lead(at + F.col("first_min")).over(Window.partitionBy("channel").orderBy("date"))).drop("first_min")
    chained = slots.withColumn("next_min", F.lead("start_min").over(own)).join(days, ["channel", "date"])
    out = chained.withColumn("start_at", at + F.col("start_min"))
    stop = F.coalesce(at + F.col("next_min"), F.col("next_at"), at + 1440)
    return out.withColumn("stop_at", stop).where("stop_at > start_at").drop("next_min", "next_at")


def _first(keys: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1


def least(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The least row of each key. Tasks reduce their own rows to one a key first, so a key that many rows have is no burden; nulls are keys as well."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def sanitize_channels(channels: DataFrame) -> DataFrame:
    """Channels with a name and a folded id, one row an id and provider: the first's name, and the first icon and url that any of its rows has. Rejects have ``issue``."""
    return channels.select("provider", "seq", X.fold_channel_id(F.col("id")).alias("id"), "name", X.blank_to_null(F.col("icon")).alias("icon"), X.blank_to_null(F.col("url")).alias("url"), F.when(X.blank_to_null(F.col("id")).isNull() | X.blank_to_null(F.col("name")).isNull(), F.lit("invalid-channel")).alias("issue"))


def union_channels(channels: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``: id, name and order of the first, icon and url of the first that has them."""
    order = F.struct("provider", "seq")
    have = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    first = F.min_by(F.struct("id", "name", "provider", "seq"), order)
    return channels.groupBy(*keys).agg(first.alias("first"), have("icon"), have("url")).select(*[k for k in keys if k not in ("id", "provider")], F.col("first.provider").alias("provider"), F.col("first.seq").alias("seq"), F.col("first.id").alias("id"), F.col("first.name").alias("name"), "icon", "url")


def _with_epochs(programmes: DataFrame) -> DataFrame:
    """``_start`` and ``_stop`` as columns of their own: in conditions each mention would read the instants again."""
    return programmes.withColumns({"_start": I.guide_epoch(F.col("start")), "_stop": I.guide_epoch(F.col("stop"))})


def check_programmes(programmes: DataFrame, ids: DataFrame) -> DataFrame:
    """Programmes on folded ids with ``issue``: null for good rows. ``ids(provider, id)``: the channels that each provider lists."""
    known = ids.select(F.col("provider").alias("k_provider"), F.col("id").alias("k_id")).distinct()
    own = programmes.withColumn("channel", X.fold_channel_id(F.col("channel")))
    own = own.join(known, (F.col("provider") == F.col("k_provider")) & (F.col("channel") == F.col("k_id")), "left")
    own = _with_epochs(own)
    start, stop = F.col("_start"), F.col("_stop")
    bad = F.lit("invalid-programme")
    issue = (
        F.when(X.blank_to_null(F.col("channel")).isNull(), bad)
        .when(F.col("k_id").isNull(), F.lit("unknown-channel"))
        .when(X.blank_to_null(F.col("title")).isNull() | start.isNull() | stop.isNull() | (stop <= start), bad)
    )
    return own.withColumns({"issue": issue, **{c: X.blank_to_null(F.col(c)) for c in OPTIONAL}}).drop("k_provider", "k_id", "_start", "_stop")


def dedupe_identity(programmes: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The first of all programmes with the same channel, start, stop and title, as written."""
    return least(programmes, (within or []) + IDENTITY, ["provider", "seq"])


def dedupe_slots(programmes: DataFrame) -> DataFrame:
    """The first of each channel, start and stop, in published order."""
    return least(programmes, SLOT, ["provider", "seq"])


def in_order(programmes: DataFrame) -> DataFrame:
    """Published order: channel, start as an instant, start as written, order of arrival."""
    return programmes.orderBy("channel", I.guide_epoch(F.col("start")), "start", "provider", "seq")


def with_place(programmes: DataFrame) -> DataFrame:
    """``programmes`` with ``place``, from 1, in published order."""
    timed = programmes.withColumn("_epoch", I.guide_epoch(F.col("start")))
    return with_rank(timed, ["channel", "_epoch", "start", "provider", "seq"], "place").drop("_epoch")


def normalise(guide: Guide) -> tuple[Guide, DataFrame]:
    """Each provider's guide made sound, and ``issue, count`` of what was left out."""
    marked = sanitize_channels(guide.channels)
    # united once: the check, and all that is made of the guide, read this table
    channels = cut(union_channels(marked.where("issue IS NULL").drop("issue"), ["provider", "id"]), "channels")
    # checked once: the good slots and the counts both read this table
    checked = cut(check_programmes(guide.programmes, channels), "checked")
    good = checked.where("issue IS NULL").drop("issue")
    programmes = least(good, ["provider", *IDENTITY], ["seq"])
    twice = good.groupBy("provider", *IDENTITY).agg((F.count("*") - 1).alias("n")).where("n > 0").select(F.lit("duplicate-programme").alias("issue"), "n")
    one = F.lit(1).cast("long").alias("n")
    issues = marked.select("issue", one).unionAll(checked.select("issue", one)).where("issue IS NOT NULL").unionAll(twice)
    return Guide(channels, programmes, max(0, guide.days), max(0, guide.failures), guide.language, guide.languages), issues.groupBy("issue").agg(F.sum("n").alias("count"))


def validate(guide: Guide) -> None:
    """Raise on what a reader would have dropped: the writer's check."""
    ch, pr = guide.channels, guide.programmes
    bad = ch.agg(
        F.count_if(~X.is_canonical_id(F.col("id"))).alias("channel ids not in canonical form"),
        F.count_if(X.blank_to_null(F.col("name")).isNull()).alias("channels without a name"),
        (F.count("*") - F.count_distinct("id")).alias("channel ids more than once"),
    ).first()
    start, stop = F.col("_start"), F.col("_stop")
    worse = _with_epochs(pr).agg(
        F.count_if(X.blank_to_null(F.col("title")).isNull()).alias("programmes without a title"),
        F.count_if(start.isNull() | stop.isNull()).alias("programmes with an impossible instant"),
        F.count_if(stop <= start).alias("programmes that stop before they start"),
    ).first()
    lost = pr.join(ch.select(F.col("id").alias("channel")), "channel", "left_anti").count()
    found = {**bad.asDict(), **worse.asDict(), "programmes of unknown channels": lost}
    if any(found.values()):
        raise ValueError("; ".join(f"{n} {what}" for what, n in found.items() if n))


def resolve_aliases(aliases: dict) -> dict[str, str]:
    """Upper-cased id to the id that it finally stands for. Chains are followed, a cycle stops where it comes back, and targets that are no text are left out."""
    index: dict[str, str] = {}
    for alias, target in aliases.items():
        if isinstance(target, str):
            index.setdefault(alias.upper(), target)
    out = {}
    for key in index:
        seen, at = set(), key
        while at.upper() in index and at.upper() not in seen:
            seen.add(at.upper())
            at = index[at.upper()]
        out[key] = at
    return out


def canonical_id(x: Column, aliases: dict | None) -> Column:
    """The id that an alias map, which is small and on the driver, gives."""
    resolved = resolve_aliases(aliases or {})
    if not resolved:
        return x
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in resolved.items() for v in kv]), X.match_key(x)), x)


def merge(guide: Guide, aliases: dict | None = None, exclusive: bool = False) -> tuple[Guide, DataFrame]:
    """All providers' guides as one, and a row of counters.

    Channels are united by id without regard to case; the first spelling stays and programmes are
    moved to it. Additive: slots of all providers, once each. Exclusive: a channel's slots come
    from the first provider that lists it, with or without slots.
    """
    clean, _ = normalise(guide)
    channels = clean.channels.withColumn("id", canonical_id(F.col("id"), aliases)).withColumn("key", X.match_key(F.col("id")))
    united = union_channels(channels, ["key"])
    names = united.select("key", F.col("id").alias("spelling"), F.col("provider").alias("owner"))
    programmes = clean.programmes.withColumn("key", X.match_key(canonical_id(F.col("channel"), aliases))).join(names, "key")
    shadowed = programmes.where("provider > owner") if exclusive else programmes.limit(0)
    kept = (programmes.where("provider = owner") if exclusive else programmes).withColumn("channel", F.col("spelling")).drop("key", "spelling", "owner")
    marked = kept.withColumn("_first", _first(IDENTITY, "provider", "seq"))
    unique = marked.where("_first").drop("_first").withColumn("channel", X.fold_channel_id(F.col("channel")))
    language = clean.languages[0] if clean.languages else clean.language
    merged = Guide(united.drop("key").withColumn("id", X.fold_channel_id(F.col("id"))), unique, clean.days, clean.failures, language)
    counters = marked.agg(F.count_if("_first").alias("programmes"), F.count_if(~F.col("_first")).alias("duplicates"))
    # three one-row tables
    counters = counters.crossJoin(shadowed.agg(F.count("*").alias("shadowed"))).crossJoin(united.agg(F.count("*").alias("channels")))
    known = {"days": clean.days, "failures": clean.failures, "mixed_language": sum(x != language for x in clean.languages)}
    return merged, counters.withColumns({k: F.lit(v).cast("long") for k, v in known.items()})


def keep_channels(guide: Guide, ids: list[str]) -> Guide:
    """Only the given channels, compared as written."""
    return Guide(guide.channels.where(F.col("id").isin(ids)), guide.programmes.where(F.col("channel").isin(ids)), guide.days, guide.failures, guide.language)


COMPARED = ["title", "category"]


def compare(a: Guide, b: Guide, aliases: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """``breakdown``: counts by channel; ``differences``: ``kind, channel, start, stop, a, b, diffs``, of all slots that aren't equal on both sides."""
    left, right = normalise(a)[0], normalise(b)[0]

    def side(guide: Guide, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        key = X.match_key(canonical_id(F.col("id"), aliases))
        ch = guide.channels.select(key.alias("key"), canonical_id(F.col("id"), aliases).alias("id")).groupBy("key").agg(F.min("id").alias(f"id_{name}"))
        pr = guide.programmes.withColumn("key", X.match_key(canonical_id(F.col("channel"), aliases)))
        counts = pr.groupBy("key").agg(F.count("*").alias(f"programmes_{name}"))
        slots = pr.withColumn("_first", _first(["key", "start", "stop"], I.guide_epoch(F.col("start")), "start", "provider", "seq")).where("_first")
        return ch, counts, slots.select("key", "start", "stop", F.struct(*COMPARED).alias(name))

    (ca, na, sa), (cb, nb, sb) = side(left, "a"), side(right, "b")
    shown = F.coalesce("id_a", "id_b")
    channels = ca.join(cb, "key", "full_outer").select("key", shown.alias("channel"), F.col("id_a").isNotNull().alias("in_a"), F.col("id_b").isNotNull().alias("in_b"))
    slots = sa.join(sb, ["key", "start", "stop"], "full_outer")
    diffs = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in COMPARED]), lambda x: x.isNotNull())
    kind = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.size("diffs") > 0, "changed").otherwise("matched")
    slots = slots.withColumn("diffs", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), diffs).otherwise(F.array().cast("array<string>"))).withColumn("kind", kind)
    slots = slots.join(channels, "key")
    kinds = ["matched", "changed", "only_a", "only_b"]
    both = F.col("in_a") & F.col("in_b")
    per = slots.groupBy("key").agg(*[F.count_if((F.col("kind") == k) & both).alias(k) for k in kinds])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    breakdown = channels.join(na, "key", "left").join(nb, "key", "left").join(per, "key", "left").select("channel", "in_a", "in_b", zero("programmes_a"), zero("programmes_b"), *[zero(k) for k in kinds])
    return breakdown, slots.where("kind <> 'matched'").select("kind", "channel", "start", "stop", "a", "b", "diffs")


def compare_summary(breakdown: DataFrame, differences: DataFrame) -> DataFrame:
    channels = breakdown.agg(
        F.count_if("in_a").alias("channels_a"), F.count_if("in_b").alias("channels_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("common"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a_channels"), F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b_channels"),
        F.sum("programmes_a").alias("programmes_a"), F.sum("programmes_b").alias("programmes_b"), F.sum("matched").alias("matched"),
    )
    slots = differences.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("changed", "only_a", "only_b")])
    return channels.crossJoin(slots)  # two one-row tables


def fetch_mode_summary(breakdown: DataFrame, differences: DataFrame) -> DataFrame:
    """``compare_summary`` of one guide fetched in two ways, over http (a) and by a browser (b)."""
    names = {"channels_a": "http_channels", "channels_b": "browser_channels", "programmes_a": "http_programmes", "programmes_b": "browser_programmes", "only_a_channels": "only_http_channels", "only_b_channels": "only_browser_channels", "only_a": "only_http", "only_b": "only_browser"}
    return compare_summary(breakdown, differences).withColumnsRenamed(names)


def slot_key(channel: Column, start: Column, stop: Column) -> Column:
    return F.concat_ws("|", channel, start, stop)


def reconcile(listed: DataFrame, channels: DataFrame) -> DataFrame:
    """``side, key``: ``missing`` are ids of ``listed(id)`` that ``channels`` lacks, ``stray`` those that only ``channels`` has; case doesn't matter."""
    key = X.match_key(F.col("id")).alias("key")
    a, b = listed.select(key).distinct(), channels.select(key).distinct()
    return a.join(b, "key", "left_anti").select(F.lit("missing").alias("side"), "key").unionByName(b.join(a, "key", "left_anti").select(F.lit("stray").alias("side"), "key"))


def report_lines(breakdown: DataFrame, differences: DataFrame, name_a: str, name_b: str, limit: int = 10) -> list[str]:
    """A text report: totals, the channels, and the first differences."""
    s = compare_summary(breakdown, differences).first()
    lines = [f"compare providers: {name_a} vs {name_b}"]
    lines.append(f"  channels:   {name_a} {s.channels_a} | {name_b} {s.channels_b} | common {s.common} | only-{name_a} {s.only_a_channels} | only-{name_b} {s.only_b_channels}")
    lines.append(f"  programmes: {name_a} {s.programmes_a} | {name_b} {s.programmes_b} | matched {s.matched} | changed {s.changed} | only-{name_a} {s.only_a} | only-{name_b} {s.only_b}")
    shown = differences.orderBy("channel", "start", "stop", "kind").limit(limit).collect()
    for d in shown:
        slot = f"{d.channel}|{d.start}|{d.stop}"
        if d.kind == "changed":
            word = lambda x, d=d: " ".join(f'{f}="{x[f]}"' for f in d.diffs)
            lines.append(f"  [changed] {slot}  {name_a} {word(d.a)} -> {name_b} {word(d.b)}")
        else:
            name, x = (name_a, d.a) if d.kind == "only_a" else (name_b, d.b)
            lines.append(f'  [only {name}] {slot}  "{x.title}"')
    if not shown:
        lines.append("  result: no differences")
    return lines

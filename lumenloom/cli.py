"""Commands over files: merge guides, compare two, read one provider's saved pages, or build a playlist.

``main`` gives 0, or 1 after a line on what was wrong; an empty guide is never written.
"""

from __future__ import annotations

import argparse
import datetime as dt
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom import settings
from lumenloom.operators import guide as G
from lumenloom.operators import playlist as P
from lumenloom.operators.guide import Guide
from lumenloom.providers import Catalog, context, provider_of_file
from lumenloom.sources import m3u, xmltv

# Fixed value: the widest window, in days either way.
MAX_WINDOW = 60
# The playlist flags that take a number, with its bounds.
M3U_NUMBERS = {
    "m3u-max-copies": (0, 1000), "m3u-max-bytes": (1024, 256 * 1024 * 1024), "m3u-live-timeout-ms": (100, 120_000),
    "m3u-live-concurrency": (1, 8), "m3u-live-depth": (1, 2), "m3u-live-retry": (0, 5),
}
#: Playlist flags that turn an option on or off.
M3U_SWITCHES = {"m3u-keep-scheme": ("unify_scheme", False), "m3u-keep-query": ("keep_query", True), "m3u-no-infer-tvg-id": ("infer_id", False), "m3u-no-yedek": ("use_backups", False)}
_LIVE_KEYS = {"m3u-live-timeout-ms": "timeoutMs", "m3u-live-concurrency": "concurrency", "m3u-live-depth": "depth", "m3u-live-retry": "retries"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenloom", description=__doc__)
    for flag in ("date", "provider", "from", "output", "alias-map", "pages", "m3u", "m3u-catalog", "m3u-want", "m3u-exclude", "m3u-style", "m3u-report", "m3u-sources", "m3u-strip-quality", "max-channels", "env-file", *M3U_NUMBERS):
        p.add_argument(f"--{flag}")
    p.add_argument("--days-forward", default="0")
    p.add_argument("--days-back", default="0")
    for flag in ("merge", "compare", "exclusive-channels", "sports-only", "gzip", *M3U_SWITCHES, "m3u-live", "m3u-live-keep"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def _days(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\d{1,4}", text.strip()) and int(text) <= MAX_WINDOW else None


def complaints(a: argparse.Namespace) -> Iterator[str]:
    """What is wrong with the flags, in the order in which it is reported."""
    if a.date and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", a.date):
        yield f"--date: YYYY-MM-DD expected, not {a.date}"
    elif a.date:
        try:
            dt.date.fromisoformat(a.date)
        except ValueError:
            yield f"--date: {a.date} is no date"
    if None in (_days(a.days_forward), _days(a.days_back)):
        yield f"--days-forward, --days-back: whole numbers from 0 to {MAX_WINDOW} expected"
    providers, files = settings.split_list(a.provider), getattr(a, "from")
    if a.provider is not None and not providers:
        yield "--provider: an id is missing"
    if a.compare and a.merge:
        yield "--compare and --merge exclude each other"
    if a.compare and len(providers) > 2:
        yield "--compare: two providers at most"
    if len(providers) > 1 and not (a.merge or a.compare):
        yield "several providers need --merge or --compare"
    if not a.m3u:
        if files is not None and not (a.merge or a.compare):
            yield "--from needs --merge or --compare"
        if files is not None and not settings.split_list(files):
            yield "--from: a path is missing"
        for flag in ("exclusive_channels", "sports_only"):
            if getattr(a, flag) and not a.merge:
                yield f"--{flag.replace('_', '-')} needs --merge"
    elif a.merge or a.compare or a.exclusive_channels or a.sports_only or files or a.provider:
        yield "--m3u excludes the flags of guides"
    if a.max_channels is not None and not re.fullmatch(r"[1-9]\d*", a.max_channels):
        yield "--max-channels: a positive whole number expected"


def window(a: argparse.Namespace, zone: str) -> list[dt.date]:
    """The dates asked for, around the given one or today in the provider's zone."""
    from zoneinfo import ZoneInfo

    anchor = dt.date.fromisoformat(a.date) if a.date else dt.datetime.now(ZoneInfo(zone)).date()
    return [anchor + dt.timedelta(k) for k in range(-_days(a.days_back), _days(a.days_forward) + 1)]


def _ordered(guides: list[Guide]) -> Guide:
    """Guides as one, each a provider of its own by its place in the list."""
    place = lambda df, k: df.withColumn("provider", F.lit(k))
    union: Callable[[list[DataFrame]], DataFrame] = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return Guide(union([place(g.channels, k) for k, g in enumerate(guides)]), union([place(g.programmes, k) for k, g in enumerate(guides)]), sum(g.days for g in guides), sum(g.failures for g in guides), guides[0].language, tuple(g.language for g in guides))


def is_empty(guide: Guide, keep_channels: bool = False) -> bool:
    return guide.channels.isEmpty() or not keep_channels and guide.programmes.isEmpty()


class Refused(ValueError):
    """Nothing to write, or nothing to read."""


def _publish(guide: Guide, path: str, gzip: bool, what: str) -> None:
    if is_empty(guide):
        raise Refused(f"nothing {what}: no empty guide is written")
    xmltv.write(guide, path, gzip)


def _guides(spark: SparkSession, a: argparse.Namespace, catalog: Catalog) -> list[tuple[str, Guide]]:
    files = settings.split_list(getattr(a, "from"))
    if files:
        return [(provider_of_file(f) or f, xmltv.read(spark, [f])) for f in files]
    out = []
    for ident in settings.split_list(a.provider):
        provider = catalog[ident]
        if provider.source is None or not a.pages:
            raise Refused(f"provider {ident}: a source and --pages are needed")
        out.append((ident, provider.source.read(spark, [a.pages], window(a, context(provider).zone))))
    if not out:
        raise Refused("--provider or --from is needed")
    return out


def _name(ident: str, country: str, gzip: bool) -> str:
    return f"epg_{ident}_{country}.xml{'.gz' if gzip else ''}"


def run(spark: SparkSession, a: argparse.Namespace, catalog: Catalog, log: Callable[[str], None]) -> None:
    if a.m3u:
        return playlist(spark, a, log)
    aliases = settings.load_aliases(a.alias_map) if a.alias_map else None
    guides = _guides(spark, a, catalog)
    if a.compare:
        if len(guides) != 2:
            raise Refused("--compare: two guides are needed")
        (na, ga), (nb, gb) = guides
        for line in G.report_lines(*G.compare(ga, gb, aliases), na, nb):
            log(line)
        return None
    if a.merge:
        kept = [g if not a.sports_only or (ids := catalog.sports_ids(n)) is None else G.keep_channels(g, ids) for n, g in guides]
        merged, counters = G.merge(_ordered(kept), aliases, a.exclusive_channels)
        lead = None if getattr(a, "from") else catalog[guides[0][0]]
        _publish(merged, a.output or _name("merged", context(lead).country, a.gzip), a.gzip, "merged")
        log(f"merged: {counters.first().asDict()}")
        return None
    ident, guide = guides[0]
    if a.max_channels:
        from lumenloom.operators.lookup import first_channels

        few = first_channels(guide.channels, int(a.max_channels))
        guide = Guide(few, guide.programmes.join(few.select("provider", F.col("id").alias("channel")), ["provider", "channel"], "left_semi"), guide.days, guide.failures, guide.language)
    _publish(G.normalise(guide)[0], a.output or _name(ident, context(catalog[ident]).country, a.gzip), a.gzip, "read")
    return None


def overridden(s: settings.PlaylistSettings, a: argparse.Namespace) -> settings.PlaylistSettings:
    """The settings as the flags change them: a flag counts more than the file, globs add to the file's."""
    given = vars(a)
    flag = lambda name: given[name.replace("-", "_")]
    changes = {option: value for name, (option, value) in M3U_SWITCHES.items() if flag(name)}
    changes["want"] = s.options.want + settings.split_list(a.m3u_want)
    changes["exclude"] = s.options.exclude + settings.split_list(a.m3u_exclude)
    if a.m3u_style is not None:
        if a.m3u_style not in P.STYLES:
            raise Refused(f"--m3u-style: one of {', '.join(P.STYLES)} expected")
        changes["style"] = a.m3u_style
    if a.m3u_strip_quality is not None:
        changes["quality_tokens"] = tuple(settings.split_list(a.m3u_strip_quality))
    numbers = {}
    for name, (low, high) in M3U_NUMBERS.items():
        if (text := flag(name)) is None:
            continue
        if not re.fullmatch(r"\d{1,9}", text) or not low <= int(text) <= high:
            raise Refused(f"--{name}: a whole number from {low} to {high} expected")
        numbers[name] = int(text)
    if "m3u-max-copies" in numbers:
        changes["max_copies"] = numbers["m3u-max-copies"]
    live = s.live | {_LIVE_KEYS[k]: v for k, v in numbers.items() if k in _LIVE_KEYS}
    if a.m3u_live or a.m3u_live_keep:
        live["enabled"] = True
    if a.m3u_live_keep:
        live["keepFailed"] = True
    sources = s.sources
    if a.m3u_sources is not None:
        sources = [{"id": f"source-{k}", "name": f"source-{k}", "path": path, "weight": 0.0} for k, path in enumerate(settings.split_list(a.m3u_sources), 1)]
    return replace(s, sources=sources, options=replace(s.options, **changes), max_bytes=numbers.get("m3u-max-bytes", s.max_bytes), live=live)


def playlist(spark: SparkSession, a: argparse.Namespace, log: Callable[[str], None]) -> None:
    """Builds and writes the playlist of a settings file and the flags. Probing is left out, so live settings are read and checked only."""
    catalog = settings.load_catalog(a.m3u_catalog) if a.m3u_catalog else None
    s = overridden(settings.load_playlist(a.m3u, catalog=catalog), a)
    if not s.sources:
        raise Refused("--m3u-sources: a path is missing")
    entries, _ = m3u.read(spark, s.sources, s.max_bytes)
    built = P.build(entries, s.options)
    if s.options.style == "fail" and (clash := built.conflicts.limit(10).collect()):
        raise Refused("several feeds of " + ", ".join(r.base_name for r in clash))
    if built.entries.isEmpty():
        raise Refused("nothing selected: no empty playlist is written")
    m3u.write(built.entries, a.output or s.output, s.keep_attributes, s.options.style == "none", a.gzip or s.gzip)
    for row in built.unmatched.collect():
        log(f"no entry for {row.pattern}")
    if a.m3u_report:
        with open(a.m3u_report, "w", encoding="utf-8") as f:
            f.write(P.report(built))
    log(f"playlist: {built.stats.first().asDict()}")


def main(arguments: list[str], spark: SparkSession | None = None, catalog: Catalog | None = None, log: Callable[[str], None] = print) -> int:
    a = parser().parse_args(arguments)
    if (wrong := next(complaints(a), None)) is not None:
        print(wrong, file=sys.stderr)
        return 1
    if a.env_file:
        settings.apply_env(settings.read_env(a.env_file))
    session = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(session, a, catalog or Catalog(), log)
    except (Refused, settings.SettingsError, KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0

"""Providers: what a guide source must offer, the catalog of them, profiles that combine them, and notes on what was published."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators.guide import Guide

# What a provider without a sound country, language or zone is given.
COUNTRY, LANGUAGE, ZONE = "TR", "tr", "Europe/Istanbul"

_FILE = r"^epg_(.+)_([A-Za-z]{2})\.xml(?:\.gz)?$"


@runtime_checkable
class GuideSource(Protocol):
    """Reads a provider's saved pages or files; injected wherever a provider is read, in tests as well."""

    def read(self, spark: SparkSession, paths: list[str], dates: list[dt.date]) -> Guide: ...


@dataclass(frozen=True)
class Provider:
    id: str
    name: str = ""
    country: str | None = None
    language: str | None = None
    zone: str | None = None
    source: GuideSource | None = None
    channel_ids: tuple[str, ...] = ()
    sports_ids: tuple[str, ...] = ()
    live_sports: bool = False
    scheduled: bool = False
    schedule_order: int = 0
    arguments: tuple[str, ...] = ()


@dataclass(frozen=True)
class Context:
    country: str
    language: str
    zone: str


@dataclass(frozen=True)
class Profile:
    """A published merge: its providers in order of precedence."""

    provider_ids: tuple[str, ...]
    output: str
    exclusive: bool = False
    sports_only: bool = False
    arguments: tuple[str, ...] = ()


def context(provider: Provider | None) -> Context:
    """Country, language and zone of a provider; what is unsound is replaced by the default."""
    country, language, zone = ((getattr(provider, k, None) or "").strip() for k in ("country", "language", "zone"))
    try:
        ZoneInfo(zone)
    except (ValueError, OSError, KeyError):
        zone = ZONE
    tag = re.fullmatch(r"[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*", language)
    return Context(country.upper() if re.fullmatch("[A-Za-z]{2}", country) else COUNTRY, language if tag else LANGUAGE, zone or ZONE)


class Catalog:
    """Providers by id, in order."""

    def __init__(self, providers: Iterable[Provider] = ()):
        self._by_id: dict[str, Provider] = {}
        for p in providers:
            self.add(p)

    def add(self, provider: Provider) -> None:
        if not provider.id.strip() or provider.id in self._by_id:
            raise ValueError(f"provider {provider.id!r}: an id is needed, and only once")
        if provider.source is not None and not isinstance(provider.source, GuideSource):
            raise TypeError(f"provider {provider.id}: its source can't read")
        self._by_id[provider.id] = provider

    def __getitem__(self, ident: str) -> Provider:
        if ident not in self._by_id:
            raise KeyError(f"unknown provider {ident!r}; known are {', '.join(self._by_id)}")
        return self._by_id[ident]

    def __iter__(self):
        return iter(self._by_id.values())

    def schedule(self) -> list[dict]:
        """Providers that run daily, in their order, and their arguments."""
        daily = sorted((p for p in self if p.scheduled), key=lambda p: p.schedule_order)
        return [{"provider": p.id, "args": " ".join(p.arguments)} for p in daily]

    def sports(self, scheduled: bool = False) -> list[Provider]:
        return [p for p in self if p.live_sports and (p.scheduled or not scheduled)]

    def sports_ids(self, ident: str) -> list[str] | None:
        """The provider's sports channels, all its channels if it declares none; None, which keeps everything, of an unknown provider."""
        p = self._by_id.get(ident)
        return None if p is None else sorted(set(p.sports_ids or p.channel_ids))

    def guide_files(self, profile: Profile) -> list[str]:
        return [f"epg_{i}_{context(self[i]).country}.xml.gz" for i in profile.provider_ids]

    def inventory(self, spark: SparkSession) -> DataFrame:
        """A row for each provider: what it is and how many channels it curates."""
        rows = [(p.id, p.name, *vars(context(p)).values(), len(set(p.channel_ids)), p.live_sports, p.scheduled) for p in self]
        return spark.createDataFrame(rows, "id string, name string, country string, language string, zone string, channels int, live_sports boolean, scheduled boolean")


def provider_of_file(path: str) -> str | None:
    """``a`` of ``epg_a_TR.xml.gz``."""
    m = re.match(_FILE, path.rsplit("/", 1)[-1], re.I)
    return m[1] if m else None


def notes(channels: DataFrame, catalog: Catalog, profiles: dict[str, Profile], date: str) -> str:
    """Markdown notes on published guides of ``channels(file, id, name)``: a section a file with its channels, merged files last, with what they are made of.

    One line a file and channel reaches the driver, as the notes are one text; lines are made and sorted on executors.
    """
    label = F.translate(F.coalesce(F.nullif("name", F.lit("")), "id"), "`", "'")
    lines = channels.select("file", F.col("id"), F.concat(F.lit("- "), label, F.lit(" (`"), F.col("id"), F.lit("`)")).alias("line"))
    sections: dict[str, list[str]] = {}
    for r in lines.orderBy("file", "id").toLocalIterator():
        sections.setdefault(r.file, []).append(r.line)
    outputs = {p.output.removesuffix(".gz"): name for name, p in profiles.items()}
    merged = [f for f in sections if "_merged" in f]
    text = [f"Guides of {date}.", ""]
    for f in [f for f in sections if f not in merged]:
        text += [f"<details><summary><b>`{f}`</b>: provider `{provider_of_file(f) or 'unknown'}`, {len(sections[f])} channels</summary>", "", *sections[f], "", "</details>", ""]
    for f in merged:
        name = outputs.get(f.removesuffix(".gz"))
        made = " + ".join(f"`{i}`" for i in catalog.guide_files(profiles[name])) if name else "the guides above"
        text += [f"<details><summary><b>`{f}`</b>: merged guide{f' `{name}`' if name else ''}, {len(sections[f])} channels</summary>", "", f"United from {made}; of conflicting slots the first guide's stay."]
        if name and profiles[name].exclusive:
            text += ["", "Each channel's slots come from the first guide that lists it."]
        text += ["", "</details>", ""]
    return "\n".join(text)

"""What a run is told on the driver: playlist settings, alias maps, channel catalogs and env files.

All of it is small JSON or text; none of it grows with the data.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from lumenloom.operators.playlist import STYLES, PlaylistOptions, Rule
from lumenloom.sources.m3u import KEPT_ATTRIBUTES, MAX_BYTES

# Bounds of a settings file.
MAX_SOURCES, MAX_PATTERNS = 50, 200
DEFAULT_OUTPUT = "playlist.m3u"

_PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


class SettingsError(ValueError):
    """A settings file that can't be used; the message names the key."""


@dataclass(frozen=True)
class Setting:
    """A key of a settings file: its type, default and, of numbers, bounds."""

    kind: type
    default: object
    low: int = 0
    high: int = 2**53 - 1

    def read(self, found: Mapping, key: str, where: str = "") -> object:
        if key not in found:
            return self.default
        value, name = found[key], f"{where}{key}"
        if self.kind is bool and not isinstance(value, bool):
            raise SettingsError(f"{name}: true or false expected")
        if self.kind is int and (isinstance(value, bool) or not isinstance(value, int) or not self.low <= value <= self.high):
            raise SettingsError(f"{name}: a whole number from {self.low} to {self.high} expected")
        if self.kind is str and not (isinstance(value, str) and value.strip()):
            raise SettingsError(f"{name}: a text expected that isn't blank")
        if self.kind is list and not (isinstance(value, list) and all(isinstance(v, str) and v.strip() for v in value)):
            raise SettingsError(f"{name}: a list of texts expected that aren't blank")
        if self.kind is dict and not isinstance(value, dict):
            raise SettingsError(f"{name}: an object expected")
        return value


_TOP = {
    "sources": Setting(list, None), "catalog": Setting(bool, True), "want": Setting(list, []), "exclude": Setting(list, []), "style": Setting(str, "backup"),
    "stripQuality": Setting(list, ["HD", "FHD", "UHD", "SD"]), "useYedek": Setting(bool, True), "dedupeIdenticalUrls": Setting(bool, True), "unifyGroups": Setting(bool, True),
    "unifyScheme": Setting(bool, True), "keepQuery": Setting(bool, False), "inferTvgId": Setting(bool, True), "idSuffix": Setting(str, "tr"),
    "keepAttributes": Setting(list, list(KEPT_ATTRIBUTES)), "maxCopies": Setting(int, 6, 0, 1000), "maxBytes": Setting(int, MAX_BYTES, 1024, 256 * 1024 * 1024),
    "live": Setting(dict, {}), "output": Setting(dict, {}),
}
_LIVE = {"enabled": Setting(bool, False), "keepFailed": Setting(bool, False), "depth": Setting(int, 1, 1, 2), "timeoutMs": Setting(int, 6000, 100, 120_000), "concurrency": Setting(int, 4, 1, 8), "retries": Setting(int, 1, 0, 5)}
_OUTPUT = {"path": Setting(str, DEFAULT_OUTPUT), "gzip": Setting(bool, False)}


@dataclass
class PlaylistSettings:
    sources: list[dict]
    options: PlaylistOptions
    keep_attributes: tuple[str, ...] = KEPT_ATTRIBUTES
    max_bytes: int = MAX_BYTES
    live: dict = field(default_factory=dict)
    output: str = DEFAULT_OUTPUT
    gzip: bool = False


def _object(path: str | os.PathLike, what: str) -> dict:
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    except FileNotFoundError:
        raise SettingsError(f"{what} {path}: no such file") from None
    except (OSError, ValueError) as e:
        raise SettingsError(f"{what} {path}: {e}") from None
    if not isinstance(found, dict):
        raise SettingsError(f"{what} {path}: a JSON object expected")
    return found


def _closed(found: Mapping, known: Mapping | set, where: str) -> None:
    if unknown := sorted(set(found) - set(known)):
        raise SettingsError(f"{where}: unknown {', '.join(unknown)}")


def expand(text: str, env: Mapping[str, str], where: str = "url") -> str:
    """``${NAME}`` and ``${NAME:-otherwise}`` from ``env``. An unset or empty name without an otherwise is an error."""

    def value(m: re.Match) -> str:
        found = env.get(m[1]) or m[2]
        if found is None:
            raise SettingsError(f"{where}: {m[1]} is not set")
        return found

    return _PLACEHOLDER.sub(value, text)


def _sources(found: object, env: Mapping[str, str]) -> list[dict]:
    if not isinstance(found, list) or not 0 < len(found) <= MAX_SOURCES:
        raise SettingsError(f"sources: a list of 1 to {MAX_SOURCES} expected")
    out = []
    for k, s in enumerate(found):
        where = f"sources[{k}]"
        if not isinstance(s, dict):
            raise SettingsError(f"{where}: an object expected")
        _closed(s, {"id", "name", "url", "weight"}, where)
        if not isinstance(s.get("url"), str) or not s["url"].strip():
            raise SettingsError(f"{where}.url: a text expected that isn't blank")
        ident, weight = s.get("id"), s.get("weight")
        ident = f"source-{k + 1}" if ident is None else ident
        if not isinstance(ident, str) or not ident.strip():
            raise SettingsError(f"{where}.id: a text expected that isn't blank")
        if weight is not None and (isinstance(weight, bool) or not isinstance(weight, (int, float))):
            raise SettingsError(f"{where}.weight: a number expected")
        path = expand(s["url"], env, f"{where}.url")
        out.append({"id": ident, "name": s.get("name") or ident, "path": path, "weight": float(weight or 0)})
    return out


def catalog_rules(catalog: list[dict]) -> tuple[list[str], list[Rule]]:
    """Wanted globs and rules of a catalog of ``pattern`` and any of ``group, id, name``; what has no pattern is left out."""
    clean = lambda item, key: item[key].strip() or None if isinstance(item.get(key), str) else None
    rows = [Rule(p, clean(c, "group"), clean(c, "id"), clean(c, "name")) for c in catalog if isinstance(c, dict) and (p := clean(c, "pattern"))]
    return [r.pattern for r in rows], [r for r in rows if r.group or r.id or r.name]


def load_catalog(path: str | os.PathLike) -> list[dict]:
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def load_playlist(path: str | os.PathLike, env: Mapping[str, str] | None = None, catalog: list[dict] | None = None, want: list[str] | None = None) -> PlaylistSettings:
    """The settings file at ``path``. Wanted globs are the catalog's (unless ``"catalog": false``), then the file's, then the caller's."""
    found = _object(path, "settings")
    _closed(found, _TOP, "settings")
    v = {k: s.read(found, k) for k, s in _TOP.items() if k != "sources"}
    _closed(v["live"], _LIVE, "live")
    _closed(v["output"], _OUTPUT, "output")
    if v["style"] not in STYLES:
        raise SettingsError(f"style: one of {', '.join(STYLES)} expected")
    listed, rules = catalog_rules(catalog or []) if v["catalog"] else ([], [])
    wanted = listed + v["want"] + (want or [])
    for key, patterns in (("want", wanted), ("exclude", v["exclude"])):
        if len(patterns) > MAX_PATTERNS:
            raise SettingsError(f"{key}: at most {MAX_PATTERNS} patterns")
    options = PlaylistOptions(
        want=wanted, exclude=v["exclude"], rules=rules, style=v["style"], quality_tokens=tuple(v["stripQuality"]), use_backups=v["useYedek"], dedupe_feeds=v["dedupeIdenticalUrls"], unify_groups=v["unifyGroups"],
        unify_scheme=v["unifyScheme"], keep_query=v["keepQuery"], infer_id=v["inferTvgId"], id_suffix=v["idSuffix"].strip().lower(), max_copies=v["maxCopies"],
    )
    live, output = ({k: s.read(v[part], k, f"{part}.") for k, s in known.items()} for part, known in (("live", _LIVE), ("output", _OUTPUT)))
    sources = _sources(found.get("sources"), os.environ if env is None else env)
    return PlaylistSettings(sources, options, tuple(v["keepAttributes"]), v["maxBytes"], live, output["path"], output["gzip"])


def load_aliases(path: str | os.PathLike) -> dict:
    """A flat JSON object of aliases; :func:`lumenloom.operators.guide.resolve_aliases` follows its chains."""
    return _object(path, "alias map")


def read_env(path: str | os.PathLike) -> dict[str, str] | None:
    """``NAME=value`` lines, with ``export``, quotes and ``#`` comments; None if there is no such file."""
    try:
        text = Path(path).read_text(encoding="utf-8-sig")
    except FileNotFoundError:
        return None
    line = re.compile(r"""^[ \t]*(?:export[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*=[ \t]*(?:"([^"]*)"|'([^']*)'|`([^`]*)`|([^\n#]*))""", re.M)
    out = {}
    for name, double, single, tick, bare in line.findall(text):
        out[name] = double.replace("\\n", "\n") or single or tick or bare.strip()
    return out


def apply_env(found: Mapping[str, str] | None, target: dict | None = None) -> list[str]:
    """Set what isn't set yet; the names that were set. Values are never shown."""
    env = os.environ if target is None else target
    new = [k for k in found or {} if k not in env]
    for k in new:
        env[k] = found[k]
    return new


def split_list(text: str | None) -> list[str]:
    return [p for part in (text or "").split(",") if (p := part.strip())]

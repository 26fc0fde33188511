"""Text, identifier and URL functions as Column expressions.

White space is the set that trimming means in the feeds' own tools, which is wider than Java's
``\\s``; it is spelled out once, in ``WS``. Folding happens on upper-case text.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# Letters that fold to ASCII after upper-casing.
TURKISH = ("ÇçĞğİıÖöŞşÜü", "CCGGIIOOSSUU")
CIRCUMFLEX = ("ÂâÎîÛû", "AAIIUU")
# Tokens that describe a feed's picture and not its channel.
QUALITY_TOKENS = ("HD", "FHD", "UHD", "SD")
# Patterns of query parameters whose values never leave a report.
SECRET_PARAMETERS = ("api[_-]?key", "app[_-]?id", "key", "token", "access[_-]?token", "auth", "secret", "password", "passwd", "pwd", "signature", "sig")
# Named character references.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "hellip": "…", "mdash": "—",
    "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "ccedil": "ç", "Ccedil": "Ç", "ouml": "ö", "Ouml": "Ö", "uuml": "ü",
    "Uuml": "Ü", "auml": "ä", "Auml": "Ä", "szlig": "ß", "eacute": "é", "Eacute": "É", "scaron": "š", "Scaron": "Š",
}


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


#: The characters of ``WS``, one by one.
_BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def blank_to_null(x: Column) -> Column:
    """Null where nothing but white space stands; other values unchanged. The first other character decides."""
    return F.when(x.rlike(f"[^{WS[1:]}"), x)


def collapse_whitespace(x: Column) -> Column:
    return trim(F.regexp_replace(x, rf"{WS}+", " "))


def fold_channel_id(x: Column) -> Column:
    """Turkish ids (``.tr``, without ``/`` or ``:``) in upper-case ASCII without inner dots; others unchanged. Folding twice changes nothing."""
    base = F.translate(F.substring(x, F.lit(1), F.length(x) - 3), *TURKISH)
    return F.when(x.endswith(".tr") & ~x.rlike("[/:]"), F.concat(F.upper(F.translate(base, ".", "")), F.lit(".tr"))).otherwise(x)


def match_key(x: Column) -> Column:
    """Ids are joined by this key; their case decides spelling only."""
    return F.upper(x)


def is_canonical_id(x: Column) -> Column:
    return F.coalesce((x != "") & (x.endswith(".se") | (x.rlike(r"^[A-Z0-9]+\.[a-z]{2}$") & (fold_channel_id(x) == x))), F.lit(False))


def channel_id_from_name(name: Column, country: str = "tr") -> Column:
    folded = F.translate(F.upper(trim(_text(name))), *TURKISH)
    slug = F.regexp_replace(F.regexp_replace(folded, "[^A-Z0-9]+", "."), r"^\.+|\.+$", "")
    return F.concat(F.when(slug == "", F.lit("UNKNOWN")).otherwise(slug), F.lit("." + (country.strip().lower() or "tr")))


def normalize_channel_key(x: Column) -> Column:
    return F.upper(collapse_whitespace(_text(x)))


def strip_quality_qualifier(x: Column) -> Column:
    """Without one trailing HD, FHD, UHD or SD, unless nothing else would be left."""
    short = trim(F.regexp_replace(x, rf"(?i){WS}+(?:HD|FHD|UHD|SD){WS}*$", ""))
    return F.when(short != "", short).otherwise(x)


@F.pandas_udf(T.StringType())
def _compatible(x: pd.Series) -> pd.Series:
    """NFKC; texts in ASCII are in it already."""
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKD")


def fold_diacritics(x: Column, compatible: bool = True) -> Column:
    """Upper case without Turkish diacritics and circumflexes. ``compatible``: NFKC first, which Spark lacks and an Arrow function gives; columns known to be in that form go without."""
    text = _text(x)
    up = F.upper(_compatible(text) if compatible else text)
    return F.translate(F.translate(up, *TURKISH), *CIRCUMFLEX)


def normalize_name(x: Column, compatible: bool = True) -> Column:
    return F.trim(F.regexp_replace(fold_diacritics(x, compatible), "[^A-Z0-9]+", " "))


_RESOLUTION = rf"(?i)\({WS}*\d{{3,4}}{WS}*p{WS}*\)"


def strip_resolution(x: Column, compatible: bool = True) -> Column:
    """Normalised name without ``(360p)`` and the like, which go before the parentheses are lost."""
    return normalize_name(F.regexp_replace(_text(x), _RESOLUTION, " "), compatible)


def strip_resolution_keep_case(x: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(_text(x), _RESOLUTION, " "))


def strip_quality_tokens(x: Column, tokens=QUALITY_TOKENS, compatible: bool = True) -> Column:
    """Normalised name without the given whole tokens."""
    unwanted = [t.strip().upper() for t in tokens if t and t.strip()]
    parts = F.split(normalize_name(x, compatible), " ")
    return F.array_join(F.filter(parts, lambda t: ~t.isin(unwanted)) if unwanted else parts, " ")


def id_key(tvg_id: Column, compatible: bool = True) -> Column:
    """Key of a declared id: empty for none and for the placeholder ``ext``, else without a country and one quality token at the end."""
    raw = trim(_text(tvg_id))
    key = F.regexp_replace(normalize_name(raw, compatible), r"\s*\b(?:TR|SE)\b\s*$", "")
    key = F.trim(F.regexp_replace(key, r"\s*\b(?:HD|4K|FHD|UHD|SD)\b\s*$", ""))
    return F.when((raw == "") | (F.lower(raw) == "ext"), F.lit("")).otherwise(key)


def _distinct_filled(forms: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.array(*forms), lambda k: k != ""))


def channel_keys(tvg_id: Column, tvg_name: Column, name: Column, tokens=QUALITY_TOKENS, compatible: bool = True) -> Column:
    """The distinct keys that an entry can be known by, in order."""
    forms = [id_key(tvg_id, compatible), normalize_name(tvg_name, compatible), strip_resolution(name, compatible)]
    if tokens:
        forms.append(strip_quality_tokens(strip_resolution(name, compatible), tokens, compatible=False))
    return _distinct_filled(forms)


def selection_forms(tvg_id: Column, tvg_name: Column, name: Column, group: Column, compatible: bool = True) -> Column:
    """The distinct forms that a selection pattern is tried on."""
    return _distinct_filled([id_key(tvg_id, compatible), normalize_name(tvg_name, compatible), strip_resolution(name, compatible), normalize_name(group, compatible)])


def base_display_name(tvg_name: Column, name: Column) -> Column:
    stripped = strip_resolution_keep_case(trim(_text(name)))
    return F.coalesce(F.nullif(trim(_text(tvg_name)), F.lit("")), F.nullif(stripped, F.lit("")), trim(_text(name)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _character(reference: Column) -> Column:
    """The character that a numeric reference (without ``&`` and ``;``) names, null if XML forbids it."""
    digits = F.regexp_replace(reference, "^#[xX]?0*", "")
    code = F.when(reference.rlike("^#[xX]"), F.when(F.length(digits) < 7, F.conv(digits, 16, 10))).otherwise(F.when(F.length(digits) < 8, digits)).try_cast("long")
    legal = lambda c: (c <= 0x10FFFF) & ((c >= 0x20) | c.isin(9, 10, 13)) & ~c.between(0xD800, 0xDFFF) & ~c.isin(0xFFFE, 0xFFFF)
    return let(code, lambda c: F.when(legal(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))


def decode_entities(x: Column) -> Column:
    """Character references decoded in one pass, so ``&amp;lt;`` becomes ``&lt;``. References to characters that XML forbids, and unknown names, stay as they are."""
    reference = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"
    # one literal: a map of many would make every plan that decodes texts larger
    named = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in ENTITIES.items())), F.lit("\x01"), F.lit("\x02"))

    def decoded(t: Column) -> Column:
        body = F.substring(t, F.lit(2), F.length(t) - 2)
        found = F.when(F.startswith(t, F.lit("&#")), _character(body)).otherwise(F.try_element_at(named, body))
        return F.when(t.rlike(f"^{reference}$"), F.coalesce(found, t)).otherwise(t)

    parts = lambda t: F.regexp_extract_all(t, F.lit(rf"(?s){reference}|[^&]+|&"), F.lit(0))
    # with no other "&" than those of the five references that every writer makes, replacing them, "&amp;" last, is the same pass
    five = {k: ENTITIES[k] for k in ("lt", "gt", "quot", "apos", "amp")}
    plain = lambda t: reduce(lambda c, kv: F.replace(c, F.lit(f"&{kv[0]};"), F.lit(kv[1])), five.items(), t)
    other = lambda t: t.rlike(f"&(?!(?:{'|'.join(five)});)")
    all_of = lambda t: F.array_join(F.transform(parts(t), decoded), "")
    return let(_text(x), lambda t: F.when(~F.contains(t, F.lit("&")), t).when(other(t), all_of(t)).otherwise(plain(t)))


_XML_ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def escape_xml(x: Column) -> Column:
    marked = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], _text(x))
    return F.regexp_replace(marked, _XML_ILLEGAL, "")


def escape_attribute(x: Column, limit: int = 4096) -> Column:
    """A playlist attribute's value: no quotes, no line breaks."""
    return F.substring(F.regexp_replace(F.translate(_text(x), '"', "'"), "[\r\n]+", " "), 1, limit)


def escape_display_name(x: Column, limit: int = 4096) -> Column:
    """A playlist name: also without commas, of which the last would end the attributes."""
    return F.substring(trim(F.translate(F.regexp_replace(F.translate(_text(x), '"', "'"), "[\r\n]+", " "), ",", "")), 1, limit)


def canonical_group_title(x: Column) -> Column:
    text = collapse_whitespace(_text(x))
    low = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    return F.when(low == "undefined", F.lit("Undefined")).when(low.isin("spor", "sports"), F.lit("Sport")).otherwise(F.initcap(low))


def is_placeholder_label(x: Column) -> Column:
    return F.lower(trim(_text(x))).isin("", "undefined")


def to_portable_id(x: Column) -> Column:
    ascii_ = F.regexp_replace(_decomposed(_text(x)), r"[\u0300-\u036F]", "")
    low = F.lower(F.translate(ascii_, "ıİ", "iI"))
    short = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9._:-]+", "."), r"^[._:-]+|[._:-]+$", "")
    return F.substring(F.regexp_replace(short, r"\.{2,}", "."), 1, 128)


def is_consumer_id(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[a-z0-9][a-z0-9._:-]{0,127}$"), F.lit(False))


def is_http_url(x: Column) -> Column:
    return F.coalesce(x.rlike(rf"^https?://(?:(?!{WS})[^|])+$"), F.lit(False))


def is_language_tag(x: Column) -> Column:
    return F.coalesce(trim(x).rlike("^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$"), F.lit(False))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_stream_url(x: Column, unify_scheme: bool = True, keep_query: bool = False) -> Column:
    """The feed that a URL names: scheme unified, host in lower case, default ports, playlist endings, final slashes and the query dropped (or its parameters sorted by name). What is no URL stays, trimmed."""
    text = trim(_text(x))
    part = lambda k: F.regexp_extract(text, _URL, k)
    scheme = F.lit("http") if unify_scheme else F.lower(part(1))
    port = F.when(part(3).isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(F.regexp_replace(part(4), r"(?i)\.m3u8?$", ""), "/+$", "")
    out = F.concat(scheme, F.lit("://"), F.lower(part(2)), port, path)
    if keep_query:
        pairs = F.filter(F.split(part(5), "&"), lambda p: p != "")
        keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
        query = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
        out = F.when(query != "", F.concat(out, F.lit("?"), query)).otherwise(out)
    return F.when(text.rlike(_URL), out).otherwise(text)


def _masked(query: Column) -> Column:
    """A query's parameters, of which secret ones have their values masked, whatever way their names are written."""
    secret = rf"(?i)^(?:{'|'.join(SECRET_PARAMETERS)})$"
    name = lambda p: F.try_url_decode(F.substring_index(p, "=", 1))
    return F.array_join(F.transform(F.split(query, "&"), lambda p: F.when(F.coalesce(name(p).rlike(secret), F.lit(False)), F.concat(name(p), F.lit("=REDACTED"))).otherwise(p)), "&")


def redact_url(x: Column) -> Column:
    """A URL that can be shown: without user name and password, and with the values of secret parameters masked. What is no absolute URL, or has nothing to hide, stays as it is."""
    text = _text(x)
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(text, parts, k)
    query = F.when(part(4) != "", F.concat(F.lit("?"), _masked(F.substring(part(4), 2, 2**31 - 1)))).otherwise("")
    return F.when(text.rlike(parts), F.concat(part(1), part(3), query, part(5))).otherwise(text)


def absolutize(x: Column, base: str) -> Column:
    base = base.rstrip("/")
    return F.when(trim(_text(x)) == "", F.lit(None).cast("string")).when(x.startswith("//"), F.concat(F.lit("https:"), x)).when(x.rlike("^(?i)https?://"), x).when(x.startswith("/"), F.concat(F.lit(base), x)).otherwise(F.concat(F.lit(base + "/"), x))


def strip_query(x: Column) -> Column:
    return F.regexp_replace(x, r"[?#].*$", "")


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(_text(x), "(?s)<[^>]*>", "")


def clean_text(x: Column) -> Column:
    """Null for blank text, else with single spaces."""
    return F.nullif(collapse_whitespace(_text(x)), F.lit(""))


def episode_label(season: Column, episode: Column) -> Column:
    s, e = F.concat(F.lit("Säsong "), season.cast("string")), F.concat(F.lit("Avsnitt "), episode.cast("string"))
    return F.nullif(F.concat_ws(", ", s, e), F.lit(""))


def glob_to_regex(pattern: str) -> str:
    """An anchored Java pattern for a selection glob: ``*`` and ``?`` only, matched on normalised forms."""
    import re
    import unicodedata

    up = lambda p: unicodedata.normalize("NFKC", p).upper().translate(str.maketrans(TURKISH[0] + CIRCUMFLEX[0], TURKISH[1] + CIRCUMFLEX[1]))
    part = lambda p: "".join("." if ch == "?" else re.sub(r"([.+^${}()|\[\]\\*])", r"\\\1", ch) for ch in " ".join(up(p).split()))
    return "(?is)^" + ".*".join(part(p) for p in pattern.split("*")) + "$"


def matches_any(forms: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    regex = "|".join(f"(?:{glob_to_regex(p)})" for p in patterns)
    return F.exists(forms, lambda f: f.rlike(regex))

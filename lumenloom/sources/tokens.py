"""A page as an array of tokens, read in one pass; sections, elements and attributes are read from the array.

A token is an opening or closing tag, a run of text, or a script or style with all it holds. Quotes
keep a ``>`` inside an attribute from ending its tag, comments and declarations are no tokens, and
CDATA is text. Nothing expects a document to be sound: what isn't closed ends with the document.
A section runs from an opening tag to the next one of its kind; what its element holds ends where
as many tags of its name are closed as were opened, or with the section.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.functions.text import let
from lumenloom.sources.markup import first_attribute

_IN_TAG = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<[!?][^>]*>"
    rf"|<(script|style)(?=[\s/>]){_IN_TAG}.*?(?:</\1(?=[\s/>])[^>]*>|\z)|</?[a-z]{_IN_TAG}|</?[a-z][^>]*>|[^<]++|<"
)
_NAME = r"^<(/?[A-Za-z][\w:-]*)"
_CDATA = r"(?is)^<!\[CDATA\[(.*?)(?:\]\]>)?$"


def tokens(x: Column) -> Column:
    """The tokens of a document as ``name, raw``: the tag in lower case, a closing one's with a slash; text has no name. Null has no tokens."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(_TOKEN), F.lit(0))
    cdata = lambda t: t.startswith("<![") & t.rlike(r"(?i)^<!\[CDATA\[")
    seen = F.filter(found, lambda t: ~t.startswith("<?") & (~t.startswith("<!") | cdata(t)))
    raw = lambda t: F.when(cdata(t), F.replace(F.replace(F.regexp_extract(t, _CDATA, 1), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))).otherwise(t)
    name = lambda t: F.when(t.startswith("<"), F.lower(F.regexp_extract(t, _NAME, 1))).otherwise("")
    return F.transform(seen, lambda t: F.struct(name(t).alias("name"), raw(t).alias("raw")))


def _opens(t: Column, tag: str | None, css: str | None) -> Column:
    named = t["name"] == tag if tag else (t["name"] != "") & ~t["name"].startswith("/")
    return named & t["raw"].rlike(rf"""(?i)\sclass\s*=\s*["'](?:[^"']*\s)?{css}""") if css else named


def sections(found: Column, *kinds: tuple[str | None, str | None]) -> Column:
    """The sections that begin with an opening tag of one of the ``kinds``: a tag, and a class that begins so, or None for any."""

    def opens(t: Column) -> Column:
        out = F.lit(False)
        for tag, css in kinds:
            out = out | _opens(t, tag, css)
        return out

    def parted(t: Column) -> Column:
        marks = F.filter(F.transform(t, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull())
        return let(marks, lambda m: F.transform(m, lambda at, k: F.slice(t, at + 1, F.coalesce(F.get(m, k + 1), F.size(t)) - at)))

    return let(found, parted)


def content(section: Column) -> Column:
    """The tokens that a section's element holds."""

    def inner(t: Column) -> Column:
        tag = F.get(t, F.lit(0))["name"]

        def step(state: Column, x: Column) -> Column:
            opened = (x["name"] == tag) & ~x["raw"].endswith("/>")
            depth = state["depth"] + F.when(opened, 1).when(x["name"] == F.concat(F.lit("/"), tag), -1).otherwise(0)
            end = F.when((state["end"] < 0) & (depth == 0) & (x["name"] != tag), state["i"]).otherwise(state["end"])
            return F.struct((state["i"] + 1).alias("i"), depth.alias("depth"), end.alias("end"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("end"))
        return let(F.aggregate(t, start, step)["end"], lambda e: F.slice(t, F.lit(2), F.greatest(F.lit(0), F.when(e < 0, F.size(t)).otherwise(e) - 1)))

    return let(section, inner)


def first(found: Column, tag: str, css: str | None = None) -> Column:
    """The first section of a kind, null without one."""
    return F.get(sections(found, (tag, css)), F.lit(0))


def element(found: Column, tag: str, css: str | None = None) -> Column:
    """What the first element of a kind holds, null without one."""
    return content(first(found, tag, css))


def until(found: Column, tag: str) -> Column:
    """The tokens before the first opening tag of a kind."""
    return let(found, lambda t: let(F.array_position(F.transform(t, lambda x: x["name"]), tag), lambda at: F.when(at > 0, F.slice(t, F.lit(1), (at - 1).cast("int"))).otherwise(t)))


def words(found: Column) -> Column:
    """Text without tags, decoded, with single spaces."""
    text = F.array_join(F.transform(F.filter(found, lambda t: t["name"] == ""), lambda t: t["raw"]), "")
    return X.collapse_whitespace(X.decode_entities(text))


def raw_attribute(section: Column, name: str) -> Column:
    """An attribute of a section's opening tag as written, null without it."""
    return first_attribute(F.get(section, F.lit(0))["raw"], name)


def attribute(section: Column, name: str) -> Column:
    """An attribute's decoded value, null without it."""
    return let(raw_attribute(section, name), lambda a: F.when(a.isNotNull(), X.decode_entities(a)))

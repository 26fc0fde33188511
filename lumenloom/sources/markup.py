"""A lenient reader of HTML and XML: sections that begin at an opening tag, attributes, children, text.

Nothing here expects a document to be sound. A section runs from an opening tag to the next one
of its kind; what it holds ends at the first closing tag, or with the section.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions import text as X

_CHILD = r"(?s)<([A-Za-z][\w:-]*)((?:\s[^>]*?)?)(?:/\s*>|>(?:(?!<\1[\s/>])(.*?))??</\1\s*>)"
_ATTRIBUTE = r"""(?<=\s)([A-Za-z_][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _opening(tag: str, css: str | None) -> str:
    return rf"<{tag}(?=[\s/>])" + (rf"""(?=[^>]*\sclass=["'](?:[^"']*\s)?{css})""" if css else "")


def sections(x: Column, tag: str, css: str | None = None) -> Column:
    """The sections of ``x`` that begin with ``<tag ..>``; ``css``: only of elements with a class that begins so."""
    opening = _opening(tag, css)
    return F.filter(F.split(F.coalesce(x, F.lit("")), f"(?i)(?={opening})"), lambda s: s.rlike(f"(?i)^{opening}"))


def content(section: Column, tag: str) -> Column:
    """What a section's element holds."""
    body = F.regexp_replace(section, r"^<[^>]*>", "")
    return F.when(body.rlike(rf"(?i)</{tag}\s*>"), F.regexp_replace(body, rf"(?is)</{tag}\s*>.*$", "")).otherwise(body)


def attributes(opening: Column) -> Column:
    """The attributes of an opening tag, or of a text that begins with one, by name in lower case; of several with one name the first counts. Values are as written."""
    return attribute_pairs(F.regexp_extract(opening, r"(?s)^<?[^>]*", 0))


def attribute_pairs(head: Column) -> Column:
    """The same of a whole tag, whatever its values hold."""
    group = lambda k: F.regexp_extract_all(head, F.lit(_ATTRIBUTE), F.lit(k))
    names = F.transform(group(1), F.lower)
    pairs = F.arrays_zip(names.alias("k"), F.zip_with(group(2), group(3), lambda a, b: F.concat(a, b)).alias("v"))
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))


def listed_attributes(head: Column) -> Column:
    """The attributes of a tag as they are written, name and value: the tag is gone through once."""
    return F.regexp_extract_all(head, F.lit(_ATTRIBUTE), F.lit(0))


def value_of(listed: Column, name: str) -> Column:
    """The value of the first of ``listed_attributes`` with a name (in lower case), null without it."""
    found = F.filter(listed, lambda a: a.rlike(rf"(?i)^{re.escape(name)}\s*="))
    return F.regexp_extract(F.get(found, F.lit(0)), r"""(?s)^[^=]*=\s*["'](.*)["']$""", 1)


def first_attribute(head: Column, name: str) -> Column:
    """One of a tag's attributes (``name`` in lower case), null without it: only this one's value is taken out."""
    return value_of(listed_attributes(head), name)


def attribute(opening: Column, name: str) -> Column:
    """An attribute's decoded value, null without it."""
    found = F.try_element_at(attributes(opening), F.lit(name))
    return F.when(found.isNotNull(), X.decode_entities(found))


def listed_children(body: Column) -> Column:
    """The elements in ``body`` as they are written: ``body`` is gone through once."""
    return F.regexp_extract_all(body, F.lit(_CHILD), F.lit(0))


def first_child(listed: Column, tag: str) -> Column:
    """The first of ``listed_children`` of a kind, as written, null without one."""
    return F.get(F.filter(listed, lambda c: c.rlike(rf"^<{re.escape(tag)}[\s/>]")), F.lit(0))


def child_text(written: Column) -> Column:
    """What one of them holds, as written."""
    return F.regexp_extract(written, _CHILD, 3)


def child_opening(written: Column) -> Column:
    """Its opening without its tag."""
    return F.regexp_extract(written, _CHILD, 2)


def words(x: Column) -> Column:
    """Text without tags, decoded, with single spaces."""
    return X.collapse_whitespace(X.decode_entities(X.strip_tags(x)))

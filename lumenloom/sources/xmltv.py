"""XMLTV files: a lenient reader and a strict writer.

The reader takes documents that no XML parser would; what is unsound is skipped. The writer
refuses what is unsound.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import instants as I
from lumenloom.functions import text as X
from lumenloom.operators.guide import Guide, dedupe_slots, least, normalise, validate
from lumenloom.operators.ranks import with_rank
from lumenloom.scratch import cut, drop
from lumenloom.sources import markup as M
from lumenloom.sources import records as R


#: A programme's end. A record is what lies between two of them: a programme's element and what stands before it, such as the channels.
_END = "</programme"


def _own(name: str) -> Column:
    return M.value_of(F.col("attrs"), name)


def _inner(tag: str) -> Column:
    return M.child_text(M.first_child(F.col("children"), tag))


def _of_inner(tag: str, name: str) -> Column:
    """An attribute of the first child of a kind."""
    return M.first_attribute(M.child_opening(M.first_child(F.col("children"), tag)), name)


def _read(elements: DataFrame, keys: list[str], tag: str, **texts: Column) -> DataFrame:
    """``keys`` and the given texts, decoded and trimmed, blank ones null; and ``lang``, the language that an element's first ``tag`` says it is in, null if it says none or no sound one.

    ``element`` is its section. Its attributes and its children are listed as written, in one pass each, and only what is
    wanted is taken apart. All texts of an element are decoded by one expression, over their array.
    """
    kind = "channel" if tag == "display-name" else "programme"
    opening = F.regexp_extract("element", r"(?s)^<?[^>]*", 0)
    elements = elements.select(*keys, M.listed_attributes(opening).alias("attrs"), M.listed_children(M.content(F.col("element"), kind)).alias("children"))
    own = texts | {"lang": _of_inner(tag, "lang")}
    decoded = F.transform(F.array(*own.values()), lambda t: X.let(X.trim(X.decode_entities(t)), lambda v: F.when(v != "", v)))
    rows = elements.select(*keys, decoded.alias("x"))
    lang = F.get("x", F.lit(len(texts)))
    return rows.select(*keys, *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate(texts)], F.when(X.is_language_tag(lang), lang).alias("lang"))


def _parse(records: DataFrame) -> Guide:
    """The guide of records, each with where it is.

    A record is scanned once. Its last programme is the one whose end it runs up to; what lies
    before is text of no sound element, or channels, which are kept as they are and read from what was written.
    What was read is written before anything looks at it again: else each later condition would be put
    together with the patterns and evaluated over and over. The guide's language is the one that is
    said first, else Turkish.
    """
    where = ["provider", *R.WHERE, "listed"]
    opened = lambda tag: F.col("value").rlike(rf"(?i)<{tag}[\s/>]")
    sections = lambda tag: F.when(opened(tag), M.sections(F.col("value"), tag))
    ended = F.filter(sections("channel"), lambda x: x.contains("</channel>"))
    found = records.select(F.col("provider"), *R.WHERE, ended.alias("listed"), F.try_element_at(sections("programme"), F.lit(-1)).alias("element"))
    texts = {"title": "title", "sub_title": "sub-title", "desc": "desc", "category": "category"}
    raw = cut(_read(found, where, "title", **{c: _own(c) for c in ("channel", "start", "stop")}, **{c: _inner(t) for c, t in texts.items()}, icon=_of_inner("icon", "src")), "records")
    at = R.placed(raw, ["provider"])
    lists = cut(at.where(F.size("listed") > 0).select("provider", "seq", F.posexplode("listed").alias("n", "element")).repartition("provider", "seq", "n"), "listed")  # a list is one record, its channels are read by many tasks
    ch = cut(_read(lists, ["provider", "seq", "n"], "display-name", id=_own("id"), name=_inner("display-name"), icon=_of_inner("icon", "src"), url=_inner("url")), "channels")
    drop(lists)
    order = ["provider", "seq", "n"]
    first = least(ch.where("id IS NOT NULL").withColumn("name", F.coalesce("name", "id")).drop("lang"), ["provider", "id"], ["seq", "n"])
    channels = with_rank(first, order, "place").select("provider", F.col("place").alias("seq"), "id", "name", "icon", "url")
    timed = cut(at.where("NOT tail").drop("listed", "tail").withColumns({"start": I.from_xmltv(F.col("start")), "stop": I.from_xmltv(F.col("stop"))}), "programmes")
    drop(raw)
    listed = channels.select("provider", F.col("id").alias("channel"))
    sound = timed.where("start IS NOT NULL AND stop IS NOT NULL AND title IS NOT NULL").drop("lang").join(listed, ["provider", "channel"], "left_semi")
    said = ch.select("provider", F.lit(0).alias("part"), "seq", "n", "lang").unionByName(timed.select("provider", F.lit(1).alias("part"), "seq", F.lit(0).alias("n"), "lang")).where("lang IS NOT NULL")
    by_provider = {r.provider: r.lang for r in said.groupBy("provider").agg(F.min_by("lang", F.struct("part", "seq", "n")).alias("lang")).collect()}  # one row a file
    providers = sorted(by_provider)
    guide, _ = normalise(Guide(channels, sound, language=by_provider[providers[0]] if providers else "tr"))
    guide.languages = tuple(by_provider[p] for p in providers)
    return guide


def parse(documents: DataFrame) -> Guide:
    """The guide of ``documents(provider, value)``, a whole document a row."""
    return _parse(R.of_documents(documents, _END, "provider"))


def read(spark: SparkSession, paths: list[str]) -> Guide:
    """The guides of files, plain or gzipped, or of folders of a guide's parts, in order of precedence.

    Plain files are read in splits of ``spark.sql.files.maxPartitionBytes``. A task holds what lies between the ends of two
    programmes: a slot, and once the list of channels. A programme whose end is missing at the end of its file is not read.
    """
    return _parse(R.read(spark, paths, _END))


def _element(tag: str, value: Column, lang: str | None = None) -> Column:
    start = f'    <{tag} lang="{lang}">' if lang else f"    <{tag}>"
    return F.concat(F.lit(start), X.escape_xml(value), F.lit(f"</{tag}>"))


def _icon(value: Column) -> Column:
    return F.concat(F.lit('    <icon src="'), X.escape_xml(value), F.lit('" />'))


def render(guide: Guide, generator: str = "lumenloom") -> DataFrame:
    """``part, k1, k2, k3, value``: the document's blocks and what they are ordered by."""
    validate(guide)
    lang = guide.language
    none = F.lit(None).cast("string")
    start = lambda c: F.lit(c).cast("string")
    spark = guide.channels.sparkSession
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tv generator-info-name="{generator}" generator-info-url="none">'
    edge = spark.createDataFrame([(0, head), (3, "</tv>")], "part int, value string").select("part", none.alias("k1"), F.lit(0).cast("long").alias("k2"), none.alias("k3"), F.lit(0).cast("long").alias("k4"), "value")
    ch = guide.channels.select(F.lit(1).alias("part"), none.alias("k1"), F.col("provider").cast("long").alias("k2"), none.alias("k3"), F.col("seq").alias("k4"), F.concat_ws("\n", F.concat(F.lit('  <channel id="'), X.escape_xml(F.col("id")), F.lit('">')), _element("display-name", F.col("name"), lang), F.when(F.col("icon").isNotNull(), _icon(F.col("icon"))), F.when(F.col("url").isNotNull(), _element("url", F.col("url"))), start("  </channel>")).alias("value"))
    optional = lambda c, t: F.when(F.col(c).isNotNull(), _element(t, F.col(c), lang))
    opening = F.concat(F.lit('  <programme start="'), I.to_xmltv(F.col("start")), F.lit('" stop="'), I.to_xmltv(F.col("stop")), F.lit('" channel="'), X.escape_xml(F.col("channel")), F.lit('">'))
    slots = dedupe_slots(guide.programmes)
    pr = slots.select(F.lit(2).alias("part"), F.col("channel").alias("k1"), I.guide_epoch(F.col("start")).alias("k2"), F.col("start").alias("k3"), F.col("seq").alias("k4"), F.concat_ws("\n", opening, _element("title", F.col("title"), lang), optional("sub_title", "sub-title"), optional("desc", "desc"), optional("category", "category"), F.when(F.col("icon").isNotNull(), _icon(F.col("icon"))), start("  </programme>")).alias("value"))
    return edge.unionByName(ch).unionByName(pr)


def write(guide: Guide, path: str, gzip: bool = True, whole: bool = True) -> int:
    """One document below ``path``, in one file or, if not ``whole``, in parts that ``read`` takes for it; gives its size in bytes."""
    # worked out once: the checks and the rendering read these tables
    own = replace(guide, channels=cut(guide.channels, "channels"), programmes=cut(guide.programmes, "programmes"))
    blocks = cut(render(own), "blocks")  # rendered once: ranges are sampled from it before it is sorted
    drop(own.channels, own.programmes)
    size = R.write(blocks, ["part", "k1", "k2", "k3", "k4"], path, gzip, whole)
    drop(blocks)
    return size

"""Conversations as one text each, with a grammar that reads back to the same turns.

    conversation := "<s>" turn*
    turn         := "[INST] " role " [/INST] " text "</s>"

The four control strings mark turns and stand nowhere else: in a role or text, ``[`` or ``<``,
then k backslashes, then the rest of a control string, is written with k + 1 backslashes, and
read with one less. That maps different texts to different texts and leaves all others as they
are. A conversation is first written as it stands and read back; only if the turns that come
back differ from the source are its conflicting contents escaped, and the result is read and
compared again. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = r"</?s>|\[/?INST\]"
_PLAIN = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
LOSS_ROLE = "assistant"
OPEN, HEAD, MID, CLOSE = "<s>", "[INST] ", " [/INST] ", "</s>"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, _PLAIN, r"$1\\$2$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPED, "$1$2$3")


def render(turns: Column, change=lambda x: x) -> Column:
    marked = F.transform(turns, lambda t: F.concat(F.lit(HEAD), change(t["role"]), F.lit(MID), change(t["text"]), F.lit(CLOSE)))
    return F.concat(F.lit(OPEN), F.array_join(marked, ""))


def _pieces(formatted: Column) -> Column:
    """What stands before each closing mark, and what stands after the last."""
    return F.split(F.substring(formatted, len(OPEN) + 1, 2**31 - 1), CLOSE, -1)


def segments(formatted: Column) -> Column:
    """The written (still escaped) role and text of each turn of a sound conversation."""
    every = _pieces(formatted)
    mid = r"\Q" + MID + r"\E"
    return F.transform(
        F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0))),
        lambda x: F.struct(
            F.substring(F.split(x, mid, 2)[0], len(HEAD) + 1, 2**31 - 1).alias("role"),
            F.coalesce(F.get(F.split(x, mid, 2), F.lit(1)), F.lit("")).alias("text"),
        ),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null for every text that the grammar doesn't give.

    The text begins with the opening mark, each turn with its head, and holds the mark between
    role and text; nothing follows the last turn, and no control string stands in a role or text.
    """
    every, found = _pieces(formatted), segments(formatted)
    turns = F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0)))
    sound = formatted.startswith(OPEN) & (F.element_at(every, -1) == "") & F.forall(turns, lambda x: x.startswith(HEAD) & F.contains(x, F.lit(MID)))
    stray = F.exists(found, lambda t: t["role"].rlike(CONTROL) | t["text"].rlike(CONTROL))
    read = F.transform(found, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return F.when(sound & ~stray, read)


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id, formatted, turns`` (read back), ``loss_spans, loss_text, escaped``.

    ``loss_spans`` are the start and length, in code points, of the formatted text's parts that
    carry loss: the texts of ``assistant`` turns as written. ``loss_text`` is what stands there,
    unescaped. A conversation is one training text, so its turns meet in one row, by turn (null
    first), then role and text; repeated rows are repeated turns. Null roles and texts are empty,
    a null id is a conversation of its own, other columns are left out, an empty table gives an
    empty one. A conversation that doesn't read back to its source stops the job.
    """
    turn = F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), turn.alias("t"))
    grouped = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    first = source.withColumn("written", render(F.col("source")))
    first = first.withColumn("escaped", ~F.coalesce(parse(F.col("written")) == F.col("source"), F.lit(False)))
    out = first.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), escape)).otherwise(F.col("written"))).drop("written")
    out = out.withColumn("turns", parse(F.col("formatted"))).withColumn("segments", segments(F.col("formatted")))
    out = out.withColumn("turns", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not read back to its source")).cast(source.schema["source"].dataType)))
    skip = len(HEAD) + len(MID)
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(len(OPEN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + skip + F.length(t["role"]) + F.length(t["text"]) + len(CLOSE)).alias("at"),
            F.when(unescape(t["role"]) == LOSS_ROLE, F.array_append(a["spans"], F.struct((a["at"] + skip + F.length(t["role"])).alias("start"), F.length(t["text"]).cast("long").alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    out = out.withColumn("loss_spans", spans)
    under = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return out.withColumn("loss_text", F.array_join(under, "")).select("conv_id", "formatted", "turns", "loss_spans", "loss_text", "escaped")


def digests(formatted: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation that is always there: both texts are made of control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = F.explode(F.array(*[F.struct(*[F.lit(v) for v in row]) for row in HOSTILE]))
    extra = spark.range(1).select(hostile.alias("x")).select("x.*").toDF("conv_id", "turn", "role", "text").select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns])
    return digests(format_conversations(rows.unionByName(extra)))


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g') AS erole, regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g') AS etext FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    3 + sum(20 + length(erole) + length(etext)) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

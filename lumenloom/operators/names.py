"""Unique names: each row's wish, or the wish with the next number that is free.

Rows come in output order (``channel_key, copy_index``) and are served one after the other: a row
gets its wish if no earlier row was given it, else the wish's first numbered form, from 2, that
none was given. Capitals don't tell names apart. What follows is that same result without a pass
over all rows. Rows with one wish are a family. Two families have a name in common only if one's wish is a
numbered form of the other's (``A 2`` of ``A``), as numbered forms of unlike wishes differ. So
within a family the r-th row gets number r, moved on by the numbers that were gone when the
family came to them, and only wishes that are numbered forms of a family's can be gone: its
obstacles. Whether one was gone is a comparison of two places in the order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.operators.ranks import with_rank
from lumenloom.scratch import cut, drop

ORDER = ["channel_key", "copy_index"]
#: A number of more digits is never reached.
_NUMBER = r"([2-9]|[1-9]\d{1,17})"


class Form:
    """How a wish is numbered, and what a name in lower case is a numbered form of: ``parent`` and ``number``, null if of none."""

    def __init__(self, numbered: Callable[[Column, Column], Column], parent: Callable[[Column], Column], number: Callable[[Column], Column]):
        self.numbered, self.parent, self.number = numbered, parent, number


def _or_null(x: Column, pattern: str, group: int) -> Column:
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


_SPACED = rf"(?s)^(.*) {_NUMBER}$"
#: ``X``, ``X 2``, ``X 3``.
SPACED = Form(lambda c, n: F.concat(c, F.lit(" "), n.cast("string")), lambda x: _or_null(x, _SPACED, 1), lambda x: _or_null(x, _SPACED, 2).cast("long"))

_COUNTRY = r"\.[a-z]{2}"


def with_id_number(candidate: Column, n: Column) -> Column:
    """``x.tr`` becomes ``x.2.tr``; an id without a country gets the number at its end."""
    tail = F.regexp_extract(candidate, rf"(?i)({_COUNTRY})$", 1)
    head = F.substring(candidate, F.lit(1), F.length(candidate) - F.length(tail))
    return F.concat(head, F.lit("."), n.cast("string"), tail)


_WITH_COUNTRY, _WITHOUT = rf"(?s)^(.*)\.{_NUMBER}({_COUNTRY})$", rf"(?s)^(.*)(?<!{_COUNTRY})\.{_NUMBER}$"
DOTTED = Form(
    with_id_number,
    lambda x: F.coalesce(F.concat(_or_null(x, _WITH_COUNTRY, 1), _or_null(x, _WITH_COUNTRY, 3)), _or_null(x, _WITHOUT, 1)),
    lambda x: F.coalesce(_or_null(x, _WITH_COUNTRY, 2), _or_null(x, _WITHOUT, 2)).cast("long"),
)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _ranked(rows: DataFrame, active: DataFrame) -> DataFrame:
    """``_low, _r`` and the order of the families' rows, ``_r`` from 1 in each.

    Sorted by ranges, so that a family with a third of all rows is many tasks'.
    """
    placed = with_rank(rows.join(active, "_low", "left_semi").select("_low", *ORDER), ["_low", *ORDER], "_place")
    first = placed.groupBy("_low").agg(F.min("_place").alias("_first"))
    out = cut(placed.join(first, "_low").select("_low", *ORDER, (F.col("_place") - F.col("_first") + 1).alias("_r")), "families")
    drop(placed)
    return out


def _settled(obstacles: DataFrame, ranked: DataFrame, log: list[int] | None) -> DataFrame:
    """``obstacles`` with ``_gone``, whether their family found them given, and ``_won``, whether it gave them itself.

    By rounds over obstacles alone: which row comes to a number follows from the obstacles below
    it that were gone, and from whether the family's bare wish was given by its parent. Each round
    settles at least the next obstacle of each family, so the rounds end.
    """
    flag = lambda c: F.lit(False).alias(c)
    state = cut(obstacles.select("_low", "_parent", "_number", "_at", flag("_gone"), flag("_won")), "obstacles")
    times = ranked.select(F.col("_low").alias("_parent"), "_r", F.struct(*ORDER).alias("_time"))
    before = Window.partitionBy("_parent").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        bare = state.where("_won").select(F.col("_low").alias("_parent"), F.lit(1).alias("_bare"))
        passed = F.coalesce(F.sum(F.col("_gone").cast("int")).over(before), F.lit(0))
        asked = state.withColumn("_passed", passed).join(bare, "_parent", "left")
        asked = asked.withColumn("_r", F.col("_number") - F.col("_passed") - F.coalesce("_bare", F.lit(0)))
        met = asked.join(times, ["_parent", "_r"], "left")
        gone, won = F.coalesce(F.col("_at") < F.col("_time"), F.lit(False)), F.coalesce(F.col("_time") < F.col("_at"), F.lit(False))
        now = met.select("_low", "_parent", "_number", "_at", gone.alias("_gone"), won.alias("_won"), ((gone != F.col("_gone")) | (won != F.col("_won"))).alias("_new"))
        old, state = state, cut(now, "obstacles")
        drop(old)
        counted = state.agg(F.count("*"), F.count_if("_new")).first()
        if log is not None:
            log.append(counted[0])
        if not counted[1]:
            return state


def _numbers(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """The order of the families' rows and ``_n``, the number of each, 1 for the bare wish."""
    bare = state.where("_won").select("_low", F.lit(1).alias("_bare"))
    own = ranked.join(bare, "_low", "left").withColumn("_n", F.col("_r") + F.coalesce("_bare", F.lit(0))).drop("_bare")
    gone = state.where("_gone")
    if gone.isEmpty():
        return own.select(*ORDER, "_n")
    # an obstacle moves the rows from the number on that it has when those below it are left out
    i = F.row_number().over(Window.partitionBy("_parent").orderBy("_number"))
    steps = gone.select(F.col("_parent").alias("_low"), (F.col("_number") - i + 1).alias("_n"), F.lit(0).cast("long").alias("_r"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ORDER])
    holed = gone.select(F.col("_parent").alias("_low")).distinct()
    within = with_rank(own.join(holed, "_low", "left_semi").unionByName(steps), ["_low", "_n", "_r"], "_place")  # at one number steps come first
    first = within.groupBy("_low").agg(F.min("_place").alias("_first"))
    # what lies before a row in its family and isn't a row of it is a step
    moved = within.where("_r > 0").join(first, "_low").select(*ORDER, (F.col("_n") + F.col("_place") - F.col("_first") + 1 - F.col("_r")).alias("_n"))
    return own.join(holed, "_low", "left_anti").select(*ORDER, "_n").unionByName(moved)


def unique_names(rows: DataFrame, want: str, form: Form, name: str, log: list[int] | None = None) -> DataFrame:
    """``rows(channel_key, copy_index, ..)`` with ``name``, unlike for all rows whatever their capitals.

    The two columns of the order tell rows apart. Wishes that one row has, and that no family's number can be, are
    counted and not looked at again; without a wish that several rows have nothing is
    written but the counts. ``log`` gets the rows that each round writes. Null wishes stay null;
    an empty table gives an empty one.
    """
    keyed = rows.select(F.lower(want).alias("_low"), *ORDER).where("_low IS NOT NULL")
    low = F.col("_low")
    wishes = keyed.groupBy("_low").agg(F.count("*").alias("_rows"), F.min(F.struct(*ORDER)).alias("_at"))
    wishes = cut(wishes.withColumns({"_parent": form.parent(low), "_number": form.number(low)}), "wishes")
    step = wishes.where("_rows > 1").select("_low")
    if step.isEmpty():
        drop(wishes)
        return rows.withColumn(name, F.col(want))
    numbered, families, obstacles = wishes.where("_parent IS NOT NULL"), [step], []
    while True:  # as often as a name is a number of a number: "A", "A 2", "A 2 2"
        met = cut(numbered.join(step.select(F.col("_low").alias("_parent")), "_parent", "left_semi"), "met")
        if met.isEmpty():
            break
        obstacles.append(met)
        step = met.where("_rows = 1").select("_low")  # may lose its bare wish, and then be in the way itself
        families.append(step)
    ranked = _ranked(keyed, _all(families))
    if obstacles:
        numbers = _numbers(ranked, _settled(_all(obstacles), ranked, log))
    else:
        numbers = ranked.select(*ORDER, F.col("_r").alias("_n"))
    given = F.when(F.col("_n") > 1, form.numbered(F.col(want), F.col("_n"))).otherwise(F.col(want))
    return rows.join(numbers, ORDER, "left").withColumn(name, given).drop("_n")

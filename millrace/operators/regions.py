"""Marked regions in texts: parsing into sides, taking one side, and splicing replacements into lines.

A region stands between lines of seven (or ``size``) ``<`` and ``>`` signs, its sides parted by lines of ``|`` (the
common base, optional) and ``=``. Patterns work on whole texts in the JVM; there is no per-line state in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import lines_of


def region_pattern(size: int = 7) -> str:
    """One region: group 1 the upper side, group 2 the base (may be missing), group 3 the lower side."""
    mark = lambda c: rf"\Q{c * size}\E(?!\Q{c}\E)[^\n]*\n"
    part = rf"((?:(?!\Q{'<' * size}\E|\Q{'|' * size}\E|\Q{'=' * size}\E|\Q{'>' * size}\E)[^\n]*+\n)*+)"
    return rf"(?m)^{mark('<')}{part}(?:{mark('|')}{part})?{mark('=')}{part}{mark('>')}"


def regions(text: Column, size: int = 7) -> Column:
    """An array with one struct (upper, base, lower) per region; regions that are not closed are no regions."""
    whole = F.regexp_extract_all(text, F.lit(region_pattern(size)), F.lit(0))
    side = lambda x, i: F.regexp_extract(x, region_pattern(size), i)
    return F.transform(whole, lambda x: F.struct(side(x, 1).alias("upper"), side(x, 2).alias("base"), side(x, 3).alias("lower")))


def one_side(text: Column, side: str, size: int = 7) -> Column:
    """The text with every region reduced to one side (``upper``, ``base`` or ``lower``)."""
    return F.regexp_replace(text, region_pattern(size), "$" + {"upper": "1", "base": "2", "lower": "3"}[side])


def spliced(files: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of files with their edits (``start``, ``end``, ``replacement``; lines from 0, end exclusive) applied.

    Edits of a file must not overlap; an edit that replaces no line stands before the line at its start. Files without
    edits come out as they are; of the others lines and replacements are put in order once. ``key`` is unique.
    """
    marked = edits.select(key).distinct()
    lines = files.join(marked, key, "left_semi").select(key, F.posexplode(lines_of(F.col(text))).alias("_at", "_line"))
    gone = edits.where(F.col("end") > F.col("start")).select(key, F.explode(F.sequence(F.col("start").cast("int"), F.col("end").cast("int") - 1)).alias("_at"))
    kept = lines.join(gone, [key, "_at"], "left_anti").select(key, F.struct((F.col("_at").cast("long") * 2 + 1).alias("at"), F.lit(0).cast("long").alias("end"), F.col("_line").alias("line")).alias("x"))
    new = edits.select(key, F.struct((F.col("start").cast("long") * 2).alias("at"), F.col("end").cast("long").alias("end"), F.col("replacement").alias("line")).alias("x")).join(files.select(key), key, "left_semi")
    done = kept.unionByName(new).groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x")).select(key, F.array_join(F.transform("x", lambda v: v["line"]), "").alias(text))
    return done.unionByName(files.join(marked, key, "left_anti").select(key, text))


def parsed(df: DataFrame, key: str, text: str, context: int, size: int = 7) -> DataFrame:
    """One row per region of each text: (key, ``region`` from 1, ``error``, ``upper``, ``base``, ``lower``, ``answers``, ``answer``,
    ``head``, ``tail``, ``upper_start``).

    A region starts at a line of ``<``, with sides parted by lines of ``|`` (may be missing) and ``=``, then sections of answers
    (each behind a line of ``&``; ``answer`` is the first), and ends at a line of ``>``. ``error`` is ``nested`` if
    another region starts before its end, ``open`` without an end, ``no_lower`` without the line of ``=``, and
    ``unordered`` if the lines stand in another order; else null. ``head`` and ``tail`` are up to ``context`` lines around
    it, cut at the neighbouring regions. ``upper_start`` is the line (from 0) at which the upper side starts in the text
    with every region before reduced to its upper side. Lines of a text meet in one task, as the text itself does.
    """
    mark = lambda c: F.lit(c * size)
    line = F.col("line")
    kind = (
        F.when(line.startswith(F.concat(mark("<"), F.lit(" "))), "<").when(line.startswith(F.concat(mark("|"), F.lit(" "))), "|").when(F.rtrim(line, F.lit("\n")) == mark("="), "=")
        .when(line.startswith(F.concat(mark("&"), F.lit(" "))), "&").when(line.startswith(mark(">")), ">")
    )
    w = Window.partitionBy(key).orderBy("pos")
    rows = df.select(key, F.posexplode(lines_of(F.col(text))).alias("pos", "line")).withColumn("kind", kind)
    rows = rows.withColumn("region", F.sum(F.coalesce((F.col("kind") == "<").cast("int"), F.lit(0))).over(w))
    first = lambda c: F.min(F.when(F.col("kind") == c, F.col("pos")))
    own = rows.groupBy(key, "region").agg(first("<").alias("l"), first("|").alias("b"), first("=").alias("q"), first("&").alias("a"), first(">").alias("e"), F.count_if(F.col("kind") == "&").alias("answers"), F.sort_array(F.collect_list(F.struct("pos", "line", "kind"))).alias("x"))
    between = lambda lo, hi: F.array_join(F.transform(F.filter("x", lambda v: (v["pos"] > lo) & (v["pos"] < hi)), lambda v: v["line"]), "")
    after = F.transform(F.filter("x", lambda v: F.col("l").isNull() | (v["pos"] > F.col("e"))), lambda v: v["line"])
    second = F.array_min(F.transform(F.filter("x", lambda v: (v["kind"] == "&") & (v["pos"] > F.col("a"))), lambda v: v["pos"]))
    own = own.withColumn("after", F.coalesce(after, F.array().cast("array<string>"))).withColumn("a2", second)
    ordered = (F.col("l") < F.coalesce("b", "q")) & (F.coalesce("b", F.col("q") - 1) < F.col("q")) & (F.col("q") < F.coalesce("a", "e")) & (F.coalesce("a", "e") <= F.col("e"))
    by_region = Window.partitionBy(key).orderBy("region")
    error = F.when(F.col("e").isNull(), F.when(F.lead("region").over(by_region).isNotNull(), "nested").otherwise("open")).when(F.col("q").isNull(), "no_lower").when(~ordered, "unordered")
    upper = between(F.col("l"), F.coalesce("b", "q"))
    told = own.withColumn("error", error).withColumn("past", F.lag("after").over(by_region))
    extra = F.when(F.col("error").isNull() & F.col("l").isNotNull(), F.col("e") - F.col("l") + 1 - (F.coalesce("b", "q") - F.col("l") - 1)).otherwise(0)
    moved = told.withColumn("extra", F.coalesce(F.sum(extra).over(by_region.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("region > 0")
    if_right = lambda c: F.when(F.col("error").isNull(), c)
    n = F.size("past")
    return moved.select(
        key, "region", "error", if_right(upper).alias("upper"), if_right(F.when(F.col("b").isNotNull(), between(F.col("b"), F.col("q")))).alias("base"), if_right(between(F.col("q"), F.coalesce("a", "e"))).alias("lower"),
        if_right(F.col("answers")).alias("answers"), if_right(F.when(F.col("a").isNotNull(), between(F.col("a"), F.coalesce("a2", "e")))).alias("answer"),
        if_right(F.array_join(F.slice("past", F.greatest(n - context, F.lit(0)) + 1, F.lit(context)), "")).alias("head"), if_right(F.array_join(F.slice("after", 1, context), "")).alias("tail"),
        if_right(F.col("l") - F.col("extra")).alias("upper_start"),
    )

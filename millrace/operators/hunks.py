"""Unified diffs as rows: hunks, their ranges and invariants, coalescing and splitting.

A diff's lines become rows with a running hunk number; sums over one diff's lines stay within that diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import HUNK_HEADER, bare_lines


def diff_lines(df: DataFrame, key: str, patch: str) -> DataFrame:
    """(``key``, ``pos``, ``line``, ``hunk``): the lines of each diff with the number of their hunk, from 1; lines before
    the first header have hunk 0."""
    lines = df.select(key, F.posexplode(bare_lines(F.col(patch))).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    return lines.withColumn("hunk", F.sum(F.col("line").rlike(HUNK_HEADER).cast("int")).over(w))


def hunks(df: DataFrame, key: str, patch: str) -> DataFrame:
    """One row per hunk: the numbers of its header (an omitted count is 1), and counts of its lines by sign.

    ``valid`` holds if the counts agree with the header and no line has another sign.
    """
    rows = diff_lines(df, key, patch).where("hunk > 0")
    head = F.max(F.when(F.col("line").rlike(HUNK_HEADER), F.col("line")))
    sign = F.substring("line", 1, 1)
    body = ~F.col("line").rlike(HUNK_HEADER) & ~F.col("line").startswith("\\")
    out = rows.groupBy(key, "hunk").agg(
        head.alias("header"),
        F.count_if(body & (sign == " ")).alias("context"),
        F.count_if(body & (sign == "-")).alias("removed"),
        F.count_if(body & (sign == "+")).alias("added"),
        F.count_if(body & ~sign.isin(" ", "-", "+")).alias("other"),
    )
    number = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(header, r'{HUNK_HEADER}', {i}) as bigint)"), F.lit(1))
    out = out.select(key, "hunk", number(1).alias("base_start"), number(2).alias("base_len"), number(3).alias("remote_start"), number(4).alias("remote_len"), "context", "removed", "added", "other")
    agrees = (F.col("context") + F.col("removed") == F.col("base_len")) & (F.col("context") + F.col("added") == F.col("remote_len")) & (F.col("other") == 0)
    return out.withColumn("valid", agrees)


def change_runs(df: DataFrame, key: str, patch: str, gap: int) -> DataFrame:
    """Runs of changed lines of each hunk, runs parted by at least ``gap`` unchanged lines: (key, hunk, run, first, last,
    changes). A hunk would be split between its runs."""
    rows = diff_lines(df, key, patch).where("hunk > 0").where(F.col("line").startswith("+") | F.col("line").startswith("-"))
    w = Window.partitionBy(key, "hunk").orderBy("pos")
    apart = F.coalesce((F.col("pos") - F.lag("pos").over(w) > gap).cast("int"), F.lit(0))
    runs = rows.withColumn("apart", apart).withColumn("run", F.sum("apart").over(w) + 1)
    return runs.groupBy(key, "hunk", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("changes"))


def neighbours(df: DataFrame, key: str, patch: str) -> DataFrame:
    """Each changed line with the line before and behind it in its hunk, null at the hunk's ends."""
    w = Window.partitionBy(key, "hunk").orderBy("pos")
    rows = diff_lines(df, key, patch).where("hunk > 0").where(~F.col("line").rlike(HUNK_HEADER))
    rows = rows.withColumn("before", F.lag("line").over(w)).withColumn("behind", F.lead("line").over(w))
    return rows.where(F.col("line").startswith("+") | F.col("line").startswith("-"))


def parts(df: DataFrame, key: str, patch: str, gap: int) -> DataFrame:
    """Hunks split where at least ``gap`` unchanged lines stand between changes: (key, hunk, part, base_start, base_len,
    remote_start, remote_len, body).

    The unchanged lines between two parts belong to both. Hunks without a change have one part. Starts are those of
    the header, moved on by the lines left out before the part.
    """
    rows = diff_lines(df, key, patch).where("hunk > 0")
    head = rows.where(F.col("line").rlike(HUNK_HEADER)).select(key, "hunk", *(F.expr(f"cast(regexp_extract(line, r'{HUNK_HEADER}', {i}) as bigint)").alias(n) for i, n in ((1, "b0"), (3, "r0"))))
    body = rows.where(~F.col("line").rlike(HUNK_HEADER) & ~F.col("line").startswith("\\"))
    w = Window.partitionBy(key, "hunk").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sign = F.substring("line", 1, 1)
    changed = sign.isin("+", "-")
    numbered = (
        body.withColumn("base_before", F.coalesce(F.sum((sign != "+").cast("long")).over(before), F.lit(0)))
        .withColumn("remote_before", F.coalesce(F.sum((sign != "-").cast("long")).over(before), F.lit(0)))
        .withColumn("last", F.max(F.when(changed, F.col("pos"))).over(before))
        .withColumn("next", F.min(F.when(changed, F.col("pos"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("starts", (changed & (F.col("last").isNull() | (F.col("pos") - F.col("last") > gap))).cast("int"))
    )
    # a line belongs to the part of the last change before it and, between far changes, to that of the next one too
    own = numbered.withColumn("part", F.greatest(F.sum("starts").over(w), F.lit(1)))
    wide = F.col("last").isNotNull() & F.col("next").isNotNull() & ~changed & (F.col("next") - F.col("last") > gap)
    placed = own.withColumn("part", F.explode(F.when(wide, F.array("part", F.col("part") + 1)).otherwise(F.array("part"))))
    grouped = placed.groupBy(key, "hunk", "part").agg(
        F.min("base_before").alias("b1"), F.min("remote_before").alias("r1"), F.sum((sign != "+").cast("long")).alias("base_len"), F.sum((sign != "-").cast("long")).alias("remote_len"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("body")
    )
    out = grouped.join(head, [key, "hunk"])
    return out.select(key, "hunk", F.col("part").cast("long").alias("part"), (F.col("b0") + F.col("b1")).alias("base_start"), "base_len", (F.col("r0") + F.col("r1")).alias("remote_start"), "remote_len", F.transform("body", lambda x: x["line"]).alias("body"))


def coalesced(pieces: DataFrame, key: str, flag: str | None = None) -> DataFrame:
    """Pieces of a diff put together again where their base ranges overlap in equal unchanged lines.

    (key, base_start, base_len, remote_start, remote_len, body, ok, and ``flag`` if named). In order of (base_start,
    remote_start) each piece is compared with the one before: it joins it if both ranges overlap by the same number of
    lines, all of them unchanged and equal in both, and the flags are equal. A piece that overlaps the one before in any
    other way makes ``ok`` false and is not joined; pieces without lines on a side are never joined.

    A joined piece ends where the whole ends, and its last lines are the whole's, so the one before is all that matters.
    """
    order = ["base_start", "remote_start", "base_len", "remote_len", "body"]
    w = Window.partitionBy(key).orderBy(*order)
    rows = pieces.select(key, *order, *([flag] if flag else []))
    near = rows.select("*", F.lag(F.struct(*order, *([flag] if flag else []))).over(w).alias("p"), F.row_number().over(w).alias("at"))
    context = lambda body, rev: F.array_position(F.transform(F.reverse(body) if rev else body, lambda x: ~x.startswith(" ")), True)
    run = lambda body, rev: F.when(context(body, rev) > 0, context(body, rev) - 1).otherwise(F.size(body))
    base_end, remote_end = F.col("p.base_start") + F.col("p.base_len"), F.col("p.remote_start") + F.col("p.remote_len")
    n = F.greatest(base_end - F.col("base_start"), F.lit(0)).cast("int")
    sides = (F.col("p.base_len") > 0) & (F.col("p.remote_len") > 0) & (F.col("base_len") > 0) & (F.col("remote_len") > 0)
    meet = sides & ((n > 0) | ((F.col("p.remote_start") < F.col("remote_start") + F.col("remote_len")) & (F.col("remote_start") < remote_end)))
    fits = (n > 0) & (remote_end - F.col("remote_start") == n) & (n <= run(F.col("p.body"), True)) & (n <= run(F.col("body"), False))
    equal = F.slice("p.body", F.greatest(F.size("p.body") - n + 1, F.lit(1)), n) == F.slice("body", F.lit(1), n)
    same = F.col(flag).eqNullSafe(F.col(f"p.{flag}")) if flag else F.lit(True)
    told = near.withColumn("meet", F.coalesce(meet, F.lit(False))).withColumn("joins", F.col("meet") & F.coalesce(fits & equal & same, F.lit(False))).withColumn("n", F.when(F.col("joins"), n).otherwise(0))
    grouped = told.withColumn("whole", F.sum((~F.col("joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "at")
    body = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", F.slice("body", F.col("n") + 1, F.size("body")).alias("lines")))), lambda x: x["lines"]))
    out = grouped.groupBy(key, "whole").agg(
        first("base_start").alias("base_start"), F.sum(F.col("base_len") - F.col("n")).alias("base_len"), first("remote_start").alias("remote_start"), F.sum(F.col("remote_len") - F.col("n")).alias("remote_len"), body.alias("body"), first(~F.col("meet")).alias("ok"), *([first(flag).alias(flag)] if flag else [])
    )
    return out.drop("whole")


def rendered(start: Column, length: Column, remote_start: Column, remote_length: Column, body: Column) -> Column:
    """A hunk as text; a count of 1 is left out."""
    span = lambda s, n: F.when(n == 1, s.cast("string")).otherwise(F.concat_ws(",", s.cast("string"), n.cast("string")))
    return F.concat(F.lit("@@ -"), span(start, length), F.lit(" +"), span(remote_start, remote_length), F.lit(" @@\n"), F.array_join(body, "\n"), F.lit("\n"))


def changes(pieces: DataFrame, key: str) -> DataFrame:
    """The ranges of each piece without its outer unchanged lines: (key, hunk, part, base_first, base_count, remote_first,
    remote_count). Without a change all lines are context before it."""
    body = F.col("body")
    flags = F.transform(body, lambda x: ~x.startswith(" "))
    first, last = F.array_position(flags, True), F.array_position(F.reverse(flags), True)
    before = F.when(first > 0, first - 1).otherwise(F.size(body))
    behind = F.when(last > 0, last - 1).otherwise(F.lit(0))
    return pieces.select(
        key, "hunk", "part", (F.col("base_start") + before).alias("base_first"), (F.col("base_len") - before - behind).alias("base_count"), (F.col("remote_start") + before).alias("remote_first"), (F.col("remote_len") - before - behind).alias("remote_count")
    )

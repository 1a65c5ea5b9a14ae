"""Checks of answers in order: which tagged blocks an answer holds, and the first reason to turn a block down.

All checks are expressions on one row, so the whole chain is a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import lines_of

# The tags of a block and the spellings that count as such.
OPENING = r"(?m)^(?:```)?[{<|]{1,3}patched_code[|>}]{1,3}$\n"
CLOSING = r"^[{<|/]{1,4}patched_code[|>}]{1,3}(?:```|[<|]{1,2}eot[|>]{1,2})?$"

#: The reasons in the order in which they are looked for.
REASONS = ("no_block", "head_context", "tail_context", "too_short", "not_ended", "like_patch", "no_change", "repeated")


def tagged_blocks(text: Column) -> Column:
    """The contents of the blocks whose tags stand on lines of their own, each up to the next closing tag; a block without one
    is left out."""
    return F.regexp_extract_all(text, F.lit(rf"(?s){OPENING}(.*?){CLOSING}"), F.lit(1))


def _padded(text: Column, lines: Column, fits, add) -> Column:
    """``text`` with the fewest line ends added, up to one less than ``lines`` tries, so that it fits; null if it never does."""
    tries = F.greatest(lines - 1, F.lit(1))
    made = F.transform(F.sequence(F.lit(0), tries - 1), lambda k: add(text, F.repeat(F.lit("\n"), k)))
    return F.get(F.filter(made, fits), F.lit(0))


def like_patch(answer: Column, code: Column, patch: Column) -> Column:
    """Lines begin with a sign of a patch, while none of the code does and none of the patch has one in its second column."""
    sign = r"(?m)^[+\-]"
    return answer.rlike(sign) & ~F.coalesce(code.rlike(sign), F.lit(False)) & ~F.coalesce(patch.rlike(r"(?m)^[^\n][+\-]"), F.lit(False))


def judged_blocks(rows: DataFrame, item: str, response: str, patch: str, code: str, context: int) -> DataFrame:
    """(item, ``block``, ``reason``, ``resolved``): one row per tagged block, numbered from 0, and one (block null) without any.

    The context is the first and last ``context`` lines of the code. A block must begin and end with it, give or take
    some line ends; ``resolved`` is what stands between, and ``reason`` the first of ``REASONS`` that holds, null for
    an accepted block. A response that is null has no block.
    """
    lines = lines_of(F.coalesce(code, F.lit("")))
    n = F.size("_lines")
    head = F.slice("_lines", F.lit(1), F.least(F.lit(context), n))
    tail = F.slice("_lines", F.greatest(n - context, F.least(F.lit(context), n)) + 1, n)
    wide = rows.select(item, F.col(patch).alias("_patch"), F.col(code).alias("_code"), lines.alias("_lines"), F.coalesce(tagged_blocks(F.col(response)), F.array().cast("array<string>")).alias("_blocks"))
    wide = wide.select("*", head.alias("_h"), tail.alias("_t")).select(
        item, "_patch", F.array_join("_h", "").alias("_head"), F.array_join("_t", "").alias("_tail"), F.size("_h").alias("_nh"), F.size("_t").alias("_nt"),
        F.array_join(F.slice("_lines", F.size("_h") + 1, F.greatest(n - F.size("_h") - F.size("_t"), F.lit(0))), "").alias("_own"), F.posexplode_outer("_blocks").alias("block", "_text"),
    )
    begun = _padded(F.col("_text"), F.col("_nh"), lambda x: x.startswith(F.col("_head")), lambda x, ends: F.concat(ends, x))
    lead = F.concat(F.when(F.col("_head") != "", "\n").otherwise(""), F.col("_tail"))
    ended = _padded(F.col("_begun"), F.col("_nt"), lambda x: x.endswith(lead), lambda x, ends: F.concat(x, ends))
    both = wide.withColumn("_begun", begun).withColumn("_ended", ended)
    length = F.length("_ended") - F.length("_head") - F.length("_tail")
    both = both.withColumn("_length", length).withColumn("resolved", F.when(F.col("_length") >= 0, F.substr("_ended", F.length("_head") + 1, F.col("_length"))))
    r = F.col("resolved")
    reason = (
        F.when(F.col("_text").isNull(), "no_block").when(F.col("_begun").isNull(), "head_context").when(F.col("_ended").isNull(), "tail_context").when(F.col("_length") < 0, "too_short")
        .when((r != "") & ~r.endswith("\n"), "not_ended").when(like_patch(r, F.col("_own"), F.col("_patch")), "like_patch").when(r == F.col("_own"), "no_change")
    )
    found = both.select(item, "block", "resolved", reason.alias("reason"))
    # blocks of one answer meet again to find repeated ones; an answer's blocks are bounded by its text
    first = found.where("reason is null").groupBy(item, "resolved").agg(F.min("block").alias("_first"))
    met = found.alias("a").join(first.alias("b"), F.col(f"a.{item}").eqNullSafe(F.col(f"b.{item}")) & (F.col("a.resolved") == F.col("b.resolved")) & F.col("a.reason").isNull(), "left")
    again = F.col("a.reason").isNull() & (F.col("a.block") > F.col("_first"))
    return met.select(f"a.{item}", "block", F.when(again, "repeated").otherwise(F.col("a.reason")).alias("reason"), F.col("a.resolved").alias("resolved"))


def retries(judged: DataFrame, group: str, primary: str, beam: str) -> DataFrame:
    """(group, ``accepted``, ``retry``): whether the requests of a group are to be made again.

    A turned-down block can be mended if it is the first of its first beam; a group is tried again if no primary answer was
    accepted and a primary one can be mended, or none at all was accepted and any other can be mended.
    """
    good = F.col("reason").isNull()
    mend = ~good & (F.col("reason") != "repeated") & (F.col(beam) == 0) & (F.coalesce("block", F.lit(0)) == 0)
    first = F.coalesce(F.col(primary), F.lit(False))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = judged.groupBy(group).agg(F.count_if(good).alias("accepted"), any_of(good & first).alias("_p"), any_of(mend & first).alias("_mp"), any_of(mend & ~first).alias("_mo"))
    return flags.select(group, "accepted", ((~F.col("_p") & F.col("_mp")) | ((F.col("accepted") == 0) & F.col("_mo"))).alias("retry"))

"""Per-model statistics of scored answers, agreement over attempts, and changes between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scores import number, score_percent, usable

#: The classes are nested: a correct answer also counts as aligned, stripped and global.
CLASSES = {"global": None, "incorrect": "wrong", "stripped": "correct_stripped", "aligned": "correct_aligned", "correct": "correct", "error": "error"}


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def ratio(condition: Column) -> Column:
    """The share of rows for which ``condition`` holds; null counts as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def model_stats(results: DataFrame) -> DataFrame:
    """One row per model: counts, shares, token means, score means and deviations by class, mean duration.

    The mean of a class is taken over log-probabilities and then put on the percent scale; the deviation (of the
    population) is taken over values already on that scale. Classes and means without values are null.
    """
    wrong = ~F.coalesce(F.col("correct_stripped"), F.lit(False)) & ~F.coalesce(F.col("error"), F.lit(False))
    inside = {c: F.lit(True) if flag is None else wrong if flag == "wrong" else F.col(flag) for c, flag in CLASSES.items()}
    score = number(F.col("logprob"))
    scores = [x for c, on in inside.items() for x in (score_percent(F.avg(F.when(on, score))).alias(f"prob_{c}"), F.stddev_pop(F.when(on, score_percent(score))).alias(f"prob_dev_{c}"))]
    return results.groupBy("model").agg(
        F.count("*").alias("total"),
        *(count_if(F.col(c)).alias(f"n_{c}") for c in ("correct", "correct_aligned", "correct_stripped", "error")),
        *(ratio(F.col(c)).alias(f"share_{c}") for c in ("correct", "correct_aligned", "correct_stripped", "error")),
        F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg("output_tokens").alias("mean_output_tokens"),
        *scores,
        F.avg(usable(F.col("duration"))).alias("mean_duration"),
    )


def name_matches(name: Column, pattern: str) -> Column:
    """``pattern`` matches ``name`` from its first character on (not necessarily to the end)."""
    return name.rlike(f"^(?:{pattern})")


def any_of(results: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """One row: the number of keys, and for each flag the share of keys with at least one row for which it holds."""
    per_key = results.groupBy(key).agg(*(F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags))
    return per_key.agg(F.count("*").alias("entries"), *(ratio(F.col(f)).alias(f"any_{f}") for f in flags))


def turned_true(first: DataFrame, second: DataFrame, keys: Sequence[str], flags: Sequence[str], row: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys whose rows are all false in all ``flags`` in ``first`` and all true in ``second``, with equally many rows.

    Each gives one row: ``keys`` and the ``row`` columns of the last of its rows in ``second`` by ``order``. A null flag is
    neither true nor false.
    """

    def uniform(df: DataFrame, value: bool) -> Column:
        holds = F.lit(True)
        for f in flags:
            holds = holds & F.coalesce(F.col(f) == value, F.lit(False))
        return holds

    a = first.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(uniform(first, False)).alias("ok")).where("ok").select(*keys, "n")
    last = F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"r{i}") for i, c in enumerate(row)))).alias("last")
    b = second.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(uniform(second, True)).alias("ok"), last).where("ok")
    return a.join(b, [*keys, "n"]).select(*keys, *(F.col(f"last.r{i}").alias(c) for i, c in enumerate(row)))


def unfinished(items: DataFrame, done: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Items with fewer rows in ``done`` than there are ``names``; rows with other names do not count, repeated rows do."""
    wanted = names.select(name).distinct()
    need = wanted.agg(F.count("*").alias("need"))
    counts = done.join(wanted, name, "left_semi").groupBy(key).agg(F.count("*").alias("have"))
    complete = counts.join(F.broadcast(need), F.col("have") >= F.col("need"))  # one row
    return items.join(complete, key, "left_anti")


def expand_counts(counts: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column ``n`` says, numbered from 1."""
    return counts.where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def leaderboard(stats: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Places by descending ``by`` columns, ties by name. ``stats`` is an aggregate with one row per name."""
    return stats.withColumn("place", F.row_number().over(Window.orderBy(*(F.desc_nulls_last(c) for c in by), F.asc_nulls_last(name))))

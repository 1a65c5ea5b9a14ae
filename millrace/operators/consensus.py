"""Agreement among answers: equal texts are grouped, their attributes merged, and the groups ranked.

Groups of equal texts may hold a third of all rows. All aggregates combine on the map side, labels are merged in two
steps (first per group and label, then per group over the distinct labels), and no list of rows is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scores import number

PLACE = ["file_path", "local_start"]


def first_answers(answers: DataFrame) -> DataFrame:
    """The first beam and first block of each answer; null positions are no match."""
    return answers.where((F.col("multi_index") == 0) & (F.col("beam_index") == 0))


def grouped(answers: DataFrame, text: str = "resolved_version") -> DataFrame:
    """One row per (place, text): members, whole-number token means, mean score, longest duration, first endpoint.

    Nulls are left out of the means; NaN scores too. The group's ``first_id`` is its least answer.
    """
    whole_mean = lambda c: F.expr(f"sum({c}) div count({c})")
    return answers.groupBy(*PLACE, text).agg(
        F.count("*").alias("members"),
        whole_mean("input_tokens").alias("input_tokens"),
        whole_mean("output_tokens").alias("output_tokens"),
        F.avg(number(F.col("logprob"))).alias("logprob"),
        F.max(number(F.col("duration"))).alias("duration"),
        F.min("endpoint_index").alias("endpoint_index"),
        F.bool_or(~F.coalesce("no_change", F.lit(False))).alias("adapted"),
        F.min("answer_id").alias("first_id"),
    )


def ranked(groups: DataFrame) -> DataFrame:
    """Groups of a place by members, adapted ones first, then the first endpoint, then the first answer."""
    order = [F.desc("members"), F.desc("adapted"), F.asc_nulls_last("endpoint_index"), F.asc("first_id")]
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy(*PLACE).orderBy(*order)))


def split_label(name: Column) -> tuple[Column, Column]:
    """The text before the last opening bracket and the text in the brackets; a name without brackets is its own base."""
    inside = F.regexp_extract(name, r"(?s)^(.*)\(([^()]*)\)\s*$", 2)
    base = F.regexp_extract(name, r"(?s)^(.*)\(([^()]*)\)\s*$", 1)
    has = name.rlike(r"(?s)^.*\([^()]*\)\s*$")
    return F.when(has, F.regexp_replace(base, r"\s+\z", "")).otherwise(name), F.when(has, inside)


def merged_labels(answers: DataFrame, keys: Sequence[str], label: str = "model", order: str = "answer_id") -> DataFrame:
    """(keys, ``label``): the distinct names of each group, those that differ in the bracket part written once.

    Names and bracket parts stand in the order of their first row.
    """
    names = answers.select(*keys, F.explode(F.split(label, ",")).alias("name"), F.col(order).alias("at")).withColumn("name", F.trim("name")).where("name <> ''")
    first = names.groupBy(*keys, "name").agg(F.min("at").alias("at"))
    base, inside = split_label(F.col("name"))
    parts = first.select(*keys, base.alias("base"), inside.alias("inside"), "at")
    by_base = parts.groupBy(*keys, "base").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.when(F.col("inside").isNotNull(), F.struct("at", "inside")))).alias("insides"))
    joined = F.array_join(F.transform("insides", lambda x: x["inside"]), "|")
    whole = F.when(F.size("insides") > 0, F.concat("base", F.lit(" ("), joined, F.lit(")"))).otherwise(F.col("base"))
    return by_base.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "base", whole.alias("whole")))), lambda x: x["whole"]), ", ").alias("label"))


def answer_label(name: Column, variant: Column, beam: Column, multi: Column) -> Column:
    """``name (variant#beam$multi)`` with the parts that are neither null nor zero; without any part only the name."""
    part = lambda sign, c: F.when(c > 0, F.concat(F.lit(sign), c.cast("string"))).otherwise("")
    inner = F.concat(part("", variant), part("#", beam), part("$", multi))
    return F.when(inner == "", name).otherwise(F.concat(name, F.lit(" ("), inner, F.lit(")")))

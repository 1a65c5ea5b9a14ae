"""Containment joins: the first text that holds a given string anywhere.

A string can only stand in a text that holds one of its anchors. A string with a word that is parted on both sides within
it (``lib/lock.c`` has ``lock``) stands only where that whole word does; any other has its first characters as the
anchor. So the join is an equi-join on anchors, and only what meets there is compared; texts are not paired with strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INNER = r"(?<=[^A-Za-z0-9_])[A-Za-z0-9_]+(?=[^A-Za-z0-9_])"
LONGEST_GRAM = 8


def first_containing(texts: DataFrame, item: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(needle, item): each distinct ``needle`` with the least ``item`` whose ``text`` holds it, null if none does.

    Strings are compared as they are. An empty needle stands in no text, and null needles and texts are left out.
    """
    asked = needles.select(F.col(needle).alias("s")).where("s <> ''").distinct()
    inner = F.regexp_extract_all("s", F.lit(INNER), F.lit(0))
    # of several inner words the longest one is the rarest as a rule
    asked = asked.withColumn("w", F.try_element_at(F.array_sort(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), F.lit(-1))["x"])
    by_word = asked.where("w is not null")
    plain = asked.where("w is null")
    hay = texts.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    words = hay.select("i", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("w"))
    met = words.join(by_word, "w").select("i", "s")
    shortest = plain.agg(F.min(F.length("s")).alias("n")).first()["n"]
    if shortest:
        n = min(shortest, LONGEST_GRAM)
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - (n - 1)), lambda k: F.substr("t", k, F.lit(n))))
        met = met.unionByName(hay.where(F.length("t") >= n).select("i", F.explode(grams).alias("w")).join(plain.select("s", F.substring("s", 1, n).alias("w")), "w").select("i", "s"))
    held = met.join(hay, "i").where(F.col("t").contains(F.col("s"))).groupBy("s").agg(F.min("i").alias("i"))
    return asked.select("s").join(held, "s", "left").select(F.col("s").alias(needle), F.col("i").alias(item))

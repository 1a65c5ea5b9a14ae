"""Sets of names within a key: what a row has in common with all rows before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.intervals import latest_before


def earlier_sets(df: DataFrame, key: str, position: str, item: str, names: str) -> DataFrame:
    """(item, ``shares``, ``container``): whether a row has a name in common with any row before it by (position, item)
    within ``key``, and the last row before it whose names hold all of its own (null if none).

    ``names`` is a sorted array of distinct names. The first row of each name settles ``shares``. For ``container``,
    distinct sets of a key are paired on a name, and each row is laid on the sets of its key that it holds, its own
    included; so rows are never paired. Rows with a null come out with false and null.
    """
    whole = F.col(key).isNotNull() & F.col(position).isNotNull() & F.col(names).isNotNull()
    rows = df.where(whole).select(F.col(key).alias("k"), F.col(position).alias("p"), F.col(item).alias("i"), F.col(names).alias("q"))
    single = rows.select("k", "p", "i", F.explode("q").alias("name"))
    first = single.groupBy("k", "name").agg(F.min(F.struct("p", "i")).alias("f"))
    shares = single.join(first, ["k", "name"]).groupBy("i").agg(F.bool_or(F.col("f") < F.struct("p", "i")).alias("shares"))

    sets = rows.select("k", "q").distinct()
    by_name = sets.select("k", "q", F.explode("q").alias("name"))
    held = by_name.select("k", F.col("q").alias("s"), "name").join(by_name, ["k", "name"]).groupBy("k", "s", "q").agg(F.count("*").alias("n")).where(F.col("n") == F.size("q"))
    laid = rows.select("k", F.col("q").alias("s"), "p", "i").join(held.select("k", "s", "q"), ["k", "s"])
    found = latest_before(laid.select("k", "q", "p", "i", (F.col("s") == F.col("q")).alias("own")), ["k", "q"], "p", "i").where("own").select("i", F.col("earlier.item").alias("container"))
    return df.select(F.col(item).alias("i")).join(shares, "i", "left").join(found, "i", "left").select(F.col("i").alias(item), F.coalesce("shares", F.lit(False)).alias("shares"), "container")

"""The top N items of every group, by two-stage salted ranking.

Every group is hashed into subgroups by item identifier. A subgroup's rows meet in one partition, where copies of an
item are merged and the best N kept; the survivors, at most N per subgroup, are ranked by score and identifier. The
first shuffle is by (group, subgroup), so a group with a third of all rows is spread over as many tasks as there are
subgroups, and the merge of copies and the first ranking share that one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, ties: Sequence[str] = (), subgroups: int | None = None) -> DataFrame:
    """(``group``, ``item``, ``score``, ``rank``): the ``n`` best items of each group, or all if there are fewer.

    Order: higher score, then ``ties`` columns ascending with null last, then smaller item; strings in byte order, a null
    item last. Rows whose score is null or NaN never count. Rows of a group with the same item count once, by the
    best of their rows. A null group is a group. ``subgroups`` defaults to the session's number of shuffle partitions.
    Other columns of ``df`` are not read. An empty table gives no rows.
    """
    s = subgroups or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"), *(F.col(t).alias(f"t{k}") for k, t in enumerate(ties)))
    scored = slim.where(F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double")))
    order: list[Column] = [F.col("s").desc(), *(F.col(f"t{k}").asc_nulls_last() for k in range(len(ties))), F.col("i").asc_nulls_last()]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(s))).repartition("g", "salt")
    within = Window.partitionBy("g", "salt")
    # copies of an item lie in one subgroup; the first in order stands for all of them
    single = salted.withColumn("copy", F.row_number().over(Window.partitionBy("g", "salt", "i").orderBy(*order))).where("copy = 1").drop("copy")
    kept = single.withColumn("r", F.row_number().over(within.orderBy(*order))).where(F.col("r") <= n)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")

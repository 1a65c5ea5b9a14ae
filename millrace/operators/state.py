"""Keyed state as tables: content-addressed caches, upserts, and imports that win over what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: that of the last source which has the key, and there the greatest by ``order``, then by all columns.

    Sources have the same columns. The choice is an aggregate that combines on the map side; null keys are keys.
    """
    columns = sources[0].columns
    rest = [c for c in columns if c not in keys]
    tagged = [df.select(*columns).withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    best = F.max(F.struct("_source", *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"r{i}") for i, c in enumerate(rest)))).alias("_best")
    merged = rows.groupBy(*keys).agg(best)
    return merged.select(*(F.col(c) if c in keys else F.col(f"_best.r{rest.index(c)}").alias(c) for c in columns), F.col("_best._source").alias("source"))


def cached(requests: DataFrame, cache: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Requests with the cached value of their key; with ``overwrite`` every look-up misses."""
    found = cache.select(key, F.col("value"))
    if overwrite:
        found = found.where(F.lit(False))
    return requests.join(found, key, "left").withColumn("hit", F.col("value").isNotNull())

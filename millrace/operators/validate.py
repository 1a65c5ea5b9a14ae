"""Checks of configuration tables: every broken rule is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: characters that a name must not hold.
FORBIDDEN = r"[,()#$|\n\t]"


def endpoint_rules(endpoints: DataFrame) -> DataFrame:
    """(endpoint_index, rule) for endpoints that break a rule on names, addresses, delays or uniqueness."""
    name = F.regexp_replace("endpoint_name", r"(?U)^\s+|\s+\z", "")
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(name, F.lit("")) == "", "name_empty"),
            F.when(name != F.col("endpoint_name"), "name_untrimmed"),
            F.when(name.rlike(FORBIDDEN), "name_characters"),
            F.when(F.coalesce(F.col("url"), F.lit("")) == "", "url_empty"),
            F.when(F.col("max_delay") < F.col("delay"), "delay_range"),
        )
    )
    single = endpoints.select("endpoint_index", F.explode(rules).alias("rule"))
    twice = endpoints.groupBy(name.alias("n")).agg(F.count("*").alias("c"), F.collect_set("endpoint_index").alias("ids")).where("c > 1")
    return single.unionByName(twice.select(F.explode("ids").alias("endpoint_index"), F.lit("name_repeated").alias("rule")))


def primaries(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` with ``primary``: as given, but if nobody is primary then everybody is."""
    some = endpoints.agg(F.coalesce(F.bool_or("is_primary"), F.lit(False)).alias("_some"))
    return endpoints.join(F.broadcast(some)).withColumn("primary", F.when(F.col("_some"), F.coalesce("is_primary", F.lit(False))).otherwise(True)).drop("_some")  # one row

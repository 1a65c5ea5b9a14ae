"""Queries 8, 9 and 10 on the text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.encode import encoded
from millrace.llm.pack import packed, token_sizes
from millrace.llm.registry import query
from millrace.llm.sentences import sentences
from millrace.sources.tables import table

CAPACITY = 2048


@query()
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"), "doc_id", "text")


@query()
def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_sizes(table(spark, folder, "documents"), "doc_id", "text")
    return packed(sizes, "doc_id", "size", CAPACITY)


@query()
def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how full they are, in tenths of their capacity."""
    per = p9_packed(spark, folder).groupBy("container").agg(F.sum("size").alias("used"))
    return per.groupBy(F.floor(F.col("used") * 10 / CAPACITY).alias("tenths")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))


@query("SELECT count(*) AS documents, 0::BIGINT AS torn, 0::BIGINT AS overfull, true AS full_enough FROM documents WHERE text <> ''")
def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers: every text once and whole, none torn that fits, none overfull, 95 in 100 of the room
    used (but for the last container of each class)."""
    laid = p9_packed(spark, folder)
    per_text = laid.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max("start").alias("start"), F.countDistinct("part").alias("distinct"))
    torn = (F.col("parts") != F.ceil(F.col("size") / CAPACITY)) | (F.col("distinct") != F.col("parts"))
    texts = per_text.select(F.lit(1).alias("text"), torn.cast("int").alias("torn"), F.lit(0).alias("over"), F.lit(0).alias("used"))
    per = laid.groupBy("container").agg(F.sum("size").alias("used"))
    both = texts.unionByName(per.select(F.lit(0).alias("text"), F.lit(0).alias("torn"), (F.col("used") > CAPACITY).cast("int").alias("over"), "used"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    enough = total("used") >= 0.95 * CAPACITY * (F.count_if(F.col("text") == 0) - 16)
    return both.agg(total("text").alias("documents"), total("torn").alias("torn"), total("over").alias("overfull"), enough.alias("full_enough"))


@query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents"), "doc_id", "text")

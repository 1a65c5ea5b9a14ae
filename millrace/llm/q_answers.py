"""Queries 6 and 7: defective responses, and answers that differ only in form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.format_dups import collapsed, duplicates
from millrace.llm.pairs import defects
from millrace.llm.registry import query
from millrace.sources.tables import table


@query()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects(table(spark, folder, "api_responses"), table(spark, folder, "api_requests"), "response_id", "request_id", "response", "prompt", "patch", "code")


_SETS = r"""WITH f AS (
  SELECT answer_id, lower(upper(regexp_replace(regexp_replace(resolved_version, '[^\pL\pN]+', '', 'g'), '[ßẞ]', 'ss', 'g'))) AS body,
         list_sort(list_filter(list_transform(string_split(coalesce(model, ''), ','), lambda x: lower(upper(regexp_replace(regexp_replace(x, '[^\pL\pN]+', '', 'g'), '[ßẞ]', 'ss', 'g')))), lambda x: x <> '')) AS names
  FROM answers),
s AS (SELECT answer_id, min(answer_id) OVER w AS kept_answer_id, count(*) OVER w AS copies FROM f WHERE body <> '' WINDOW w AS (PARTITION BY body, names))
"""


@query(_SETS + "SELECT kept_answer_id, answer_id AS copy_answer_id FROM s WHERE answer_id <> kept_answer_id")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = duplicates(table(spark, folder, "answers"), "answer_id", "resolved_version", ["model"])
    return found.select(F.col("kept").alias("kept_answer_id"), F.col("copy").alias("copy_answer_id"))


@query(_SETS + "SELECT kept_answer_id, max(copies) AS copies FROM s GROUP BY kept_answer_id")
def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    return collapsed(table(spark, folder, "answers"), "answer_id", "resolved_version", ["model"]).withColumnRenamed("kept", "kept_answer_id")

"""Queries on broken rows and on two copies of data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import compare, rejects
from millrace.plans.registry import query
from millrace.sources.tables import table

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_PARSED = rf"""
parsed AS (
  SELECT record_id, raw_text, coalesce(regexp_full_match(raw_text, '{_FIELD}(?:,{_FIELD})*'), true) AS whole,
         list_transform(regexp_extract_all(',' || raw_text, ',((?:"(?:[^"]|"")*")|[^",]*)', 1),
                        lambda v: CASE WHEN v LIKE '"%' THEN replace(v[2:-2], '""', '"') ELSE v END) AS f
  FROM raw_entries),
reasons AS (
  SELECT record_id, f, CASE
    WHEN raw_text IS NULL THEN 'column_count'
    WHEN NOT whole THEN 'quoting'
    WHEN len(f) <> 6 THEN 'column_count'
    WHEN NOT regexp_full_match(f[4], '(?:(?:[ +\-]|@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@)[^\n]*(?:\n|\z))+')
      OR regexp_full_match(f[6], '[\s\x0b\pZ]*')
      OR regexp_matches(f[6], '[\x{{FFFD}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]')
      OR regexp_matches(f[6], '(?:\A|\n)(?:<{{7}}|={{7}}|>{{7}})') THEN 'invalid_value' END AS reason
  FROM parsed)"""


@query(f"WITH {_PARSED} SELECT record_id, reason FROM reasons WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected(table(spark, folder, "raw_entries"), "record_id", "raw_text")


@query(f"""WITH {_PARSED} SELECT record_id, f[1] AS id, f[2] AS run, f[3] AS description, f[4] AS patch, f[5] AS code, f[6] AS patched_code
           FROM reasons WHERE reason IS NULL""")
def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded(table(spark, folder, "raw_entries"), "record_id", "raw_text")


@query(f"WITH {_PARSED} SELECT reason, count(*) AS records FROM reasons WHERE reason IS NOT NULL GROUP BY reason")
def p3_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p3_found(spark, folder).groupBy("reason").agg(F.count("*").alias("records"))


_FLAGS = ["correct", "correct_aligned", "correct_stripped"]
_LATEST = """
latest AS (
  SELECT *, row_number() OVER (PARTITION BY side, entry_index, model_key ORDER BY recorded_at DESC NULLS LAST,
         correct DESC NULLS LAST, correct_aligned DESC NULLS LAST, correct_stripped DESC NULLS LAST) AS rn
  FROM (SELECT 'a' AS side, *, lower(regexp_replace(model, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) AS model_key FROM checkpoint_a
        UNION ALL BY NAME
        SELECT 'b' AS side, *, lower(regexp_replace(model, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) AS model_key FROM checkpoint_b)),
a AS (SELECT * FROM latest WHERE rn = 1 AND side = 'a'),
b AS (SELECT * FROM latest WHERE rn = 1 AND side = 'b'),
d AS (
  SELECT coalesce(a.entry_index, b.entry_index) AS entry_index, coalesce(a.model_key, b.model_key) AS model_key,
         unnest([CASE WHEN a.side IS NULL THEN 'missing_in_a' WHEN b.side IS NULL THEN 'missing_in_b' END] ||
                CASE WHEN a.side IS NULL OR b.side IS NULL THEN [] ELSE
                [CASE WHEN a.correct IS DISTINCT FROM b.correct THEN 'correct' END,
                 CASE WHEN a.correct_aligned IS DISTINCT FROM b.correct_aligned THEN 'correct_aligned' END,
                 CASE WHEN a.correct_stripped IS DISTINCT FROM b.correct_stripped THEN 'correct_stripped' END] END) AS difference
  FROM a FULL JOIN b ON a.entry_index IS NOT DISTINCT FROM b.entry_index AND a.model_key IS NOT DISTINCT FROM b.model_key)"""


def checkpoint_differences(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"entry_index": F.col("entry_index"), "model_key": F.lower(F.regexp_replace("model", r"(?U)^\s+|\s+\z", ""))}
    return compare.differences(table(spark, folder, "checkpoint_a"), table(spark, folder, "checkpoint_b"), keys, _FLAGS, latest="recorded_at")


@query(f"WITH {_LATEST} SELECT entry_index, model_key, difference FROM d WHERE difference IS NOT NULL")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoint_differences(spark, folder).select("entry_index", "model_key", "difference")


@query(f"WITH {_LATEST} SELECT model_key, difference, count(*) AS n FROM d WHERE difference IS NOT NULL GROUP BY ALL")
def p4_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoint_differences(spark, folder).groupBy("model_key", "difference").agg(F.count("*").alias("n"))

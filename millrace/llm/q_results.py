"""Queries 2 and 5: percentiles and top items of scored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.percentiles import percentiles
from millrace.llm.registry import query
from millrace.llm.top_n import top_n
from millrace.sources.tables import table

_ONCE = "once AS (SELECT result_id, any_value(model) AS model, any_value(run_day) AS run_day, any_value(duration) AS duration, any_value(output_tokens) AS output_tokens FROM results GROUP BY result_id)"
_LONG = """long AS (SELECT model, run_day, 'duration' AS measure, duration AS v FROM once WHERE duration IS NOT NULL AND NOT isnan(duration)
  UNION ALL SELECT model, run_day, 'output_tokens', output_tokens::DOUBLE FROM once WHERE output_tokens IS NOT NULL)"""
_RANKED = """ranked AS (
  SELECT model, run_day, 'part' AS scope, measure, v, count(*) OVER w AS n, row_number() OVER (w ORDER BY v) AS r FROM long WINDOW w AS (PARTITION BY model, run_day, measure)
  UNION ALL SELECT model, NULL, 'all', measure, v, count(*) OVER w, row_number() OVER (w ORDER BY v) FROM long WINDOW w AS (PARTITION BY model, measure))"""


@query(f"WITH {_ONCE}, {_LONG}, {_RANKED} SELECT model, run_day, scope, measure, percent, n, v AS value FROM ranked, (VALUES (50), (90), (99)) q(percent) WHERE r = (percent * n + 99) // 100")
def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles(table(spark, folder, "results"), "model", "run_day", ["duration", "output_tokens"], [50, 90, 99], item="result_id")


_TOP = """WITH once AS (SELECT DISTINCT entry_index, result_id, model, logprob FROM results WHERE logprob IS NOT NULL AND NOT isnan(logprob)),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_index ORDER BY logprob DESC, model NULLS LAST, result_id) AS rank FROM once)
"""


def _top(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(table(spark, folder, "results"), "entry_index", "result_id", "logprob", 5, ties=["model"])


@query(_TOP + "SELECT entry_index, result_id FROM r WHERE rank <= 5")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder).select("entry_index", "result_id")


@query(_TOP + "SELECT entry_index, result_id, logprob, rank FROM r WHERE rank <= 5")
def p5_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder)

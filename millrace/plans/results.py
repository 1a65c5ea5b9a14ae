"""Queries on scored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import analytics
from millrace.plans.registry import query
from millrace.sources.tables import table

_SCORE = "CASE WHEN {0} IS NOT NULL THEN 100 * least(greatest(pow(1e6, {0}), 0), 1) END"
_LP = "(CASE WHEN NOT isnan(logprob) THEN logprob END)"
_WRONG = "(NOT coalesce(correct_stripped, false) AND NOT coalesce(error, false))"
_STATS = ", ".join(
    f"round({_SCORE.format(f'avg({_LP}) FILTER (WHERE {on})')}, 6) AS prob_{c}, round(stddev_pop({_SCORE.format(_LP)}) FILTER (WHERE {on}), 6) AS prob_dev_{c}"
    for c, on in {"global": "true", "incorrect": _WRONG, "stripped": "correct_stripped", "aligned": "correct_aligned", "correct": "correct", "error": "error"}.items()
)


@query(f"""SELECT model, count(*) AS total,
  count_if(correct) AS n_correct, count_if(correct_aligned) AS n_correct_aligned, count_if(correct_stripped) AS n_correct_stripped, count_if(error) AS n_error,
  round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS share_correct, round(avg(CASE WHEN correct_aligned THEN 1.0 ELSE 0.0 END), 6) AS share_correct_aligned,
  round(avg(CASE WHEN correct_stripped THEN 1.0 ELSE 0.0 END), 6) AS share_correct_stripped, round(avg(CASE WHEN error THEN 1.0 ELSE 0.0 END), 6) AS share_error,
  round(avg(input_tokens), 6) AS mean_input_tokens, round(avg(output_tokens), 6) AS mean_output_tokens, {_STATS},
  round(avg(duration) FILTER (WHERE duration <> 0 AND NOT isnan(duration) AND abs(duration) < 'inf'::DOUBLE), 6) AS mean_duration
  FROM results GROUP BY model""")
def model_stats(spark: SparkSession, folder: str) -> DataFrame:
    df = analytics.model_stats(table(spark, folder, "results"))
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


_FLAGS = ["correct", "correct_aligned", "correct_stripped"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


@query("""SELECT count(*) AS entries, round(avg(c::INT), 6) AS any_correct, round(avg(a::INT), 6) AS any_correct_aligned, round(avg(s::INT), 6) AS any_correct_stripped
  FROM (SELECT entry_index, bool_or(coalesce(correct, false)) AS c, bool_or(coalesce(correct_aligned, false)) AS a, bool_or(coalesce(correct_stripped, false)) AS s FROM results GROUP BY entry_index)""")
def any_correct(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(analytics.any_of(table(spark, folder, "results"), "entry_index", _FLAGS))


@query("""SELECT count(*) AS entries, round(avg(c::INT), 6) AS any_correct FROM (
  SELECT entry_index, bool_or(coalesce(correct, false)) AS c FROM results WHERE regexp_matches(model, '^(?:Bramble|Orrin-[0-9]+)') GROUP BY entry_index)""")
def model_regex(spark: SparkSession, folder: str) -> DataFrame:
    chosen = table(spark, folder, "results").where(analytics.name_matches(F.col("model"), "Bramble|Orrin-[0-9]+"))
    return _rounded(analytics.any_of(chosen, "entry_index", ["correct"]))


@query("SELECT model, run_day, count(*) AS answers, count_if(correct) AS n_correct, count_if(error) AS n_error FROM results WHERE entry_index < 1000 GROUP BY model, run_day")
def max_entries_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "results").where(F.col("entry_index") < 1000)
    return rows.groupBy("model", "run_day").agg(F.count("*").alias("answers"), F.count_if("correct").alias("n_correct"), F.count_if("error").alias("n_error"))


@query("""SELECT row_number() OVER (ORDER BY c DESC, a DESC, s DESC, model NULLS LAST) AS place, model, round(c, 6) AS share_correct, round(a, 6) AS share_correct_aligned, round(s, 6) AS share_correct_stripped FROM (
  SELECT model, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN correct_aligned THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN correct_stripped THEN 1.0 ELSE 0.0 END) AS s FROM results GROUP BY model)""")
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    shares = [analytics.ratio(F.col(f)).alias(f"share_{f}") for f in _FLAGS]
    stats = table(spark, folder, "results").groupBy("model").agg(*shares)
    return _rounded(analytics.leaderboard(stats, [f"share_{f}" for f in _FLAGS], "model"))


@query("""WITH a AS (SELECT entry_index, model, count(*) AS n FROM checkpoint_a GROUP BY ALL HAVING bool_and(coalesce(NOT correct, false))),
  b AS (SELECT entry_index, model, count(*) AS n, max(recorded_at) AS recorded_at, max_by(duration, (recorded_at, duration)) AS duration FROM checkpoint_b GROUP BY ALL HAVING bool_and(coalesce(correct, false)))
  SELECT entry_index, model, epoch_us(b.recorded_at) AS recorded_us, b.duration FROM a JOIN b USING (entry_index, model, n)""")
def ckpt_diff(spark: SparkSession, folder: str) -> DataFrame:
    a, b = table(spark, folder, "checkpoint_a"), table(spark, folder, "checkpoint_b")
    turned = analytics.turned_true(a, b, ["entry_index", "model"], ["correct"], ["recorded_at", "duration"], ["recorded_at", "duration"])
    return turned.select("entry_index", "model", F.unix_micros("recorded_at").alias("recorded_us"), "duration")


_NAMES = "names AS (SELECT DISTINCT regexp_replace(endpoint_name, '\\s+$', '') AS model FROM endpoints)"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "endpoints").select(F.regexp_replace("endpoint_name", r"\s+\z", "").alias("model")).distinct()


@query(f"""WITH {_NAMES} SELECT entry_index FROM test_entries WHERE entry_index NOT IN (
  SELECT entry_index FROM results WHERE model IN (SELECT model FROM names) AND entry_index IS NOT NULL GROUP BY entry_index HAVING count(*) >= (SELECT count(*) FROM names))""")
def resume_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.unfinished(table(spark, folder, "test_entries").select("entry_index"), table(spark, folder, "results"), _names(spark, folder), "entry_index", "model")


@query("SELECT entry_index, count(*) AS done, count(DISTINCT model) AS models FROM results GROUP BY entry_index")
def done_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results").groupBy("entry_index").agg(F.count("*").alias("done"), F.countDistinct("model").alias("models"))


@query("SELECT result_id, count(*) AS rows FROM results GROUP BY result_id HAVING count(*) > 1")
def dup_detect(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.repeated(table(spark, folder, "results"), ["result_id"])


@query("""SELECT model, run_day, unnest(range(1, n + 1)) AS copy FROM (SELECT model, run_day, count(*) AS n FROM results WHERE error GROUP BY model, run_day)""")
def error_rows(spark: SparkSession, folder: str) -> DataFrame:
    errors = table(spark, folder, "results").where("error").groupBy("model", "run_day").agg(F.count("*").alias("n"))
    return analytics.expand_counts(errors, "n").drop("n")


@query("""SELECT model, count(*) AS total, count_if(duration = 0) AS no_call, count_if(correct AND duration <> 0) AS successes,
  round(count_if(correct AND duration <> 0) / nullif(count(*) - count_if(duration = 0), 0), 6) AS share FROM results GROUP BY model""")
def outcome_tally(spark: SparkSession, folder: str) -> DataFrame:
    good = F.count_if(F.col("correct") & (F.col("duration") != 0))
    idle = F.count_if(F.col("duration") == 0)
    stats = table(spark, folder, "results").groupBy("model").agg(F.count("*").alias("total"), idle.alias("no_call"), good.alias("successes"), F.try_divide(good, F.count("*") - idle).alias("share"))
    return _rounded(stats)


@query("""SELECT entry_index, model, class, count(*) AS n, sum(floor(logprob * 1000)::BIGINT)::BIGINT AS sum_e3 FROM (
  SELECT entry_index, model, logprob, unnest(['global'] || CASE WHEN correct_stripped THEN ['stripped'] ELSE ['incorrect'] END || CASE WHEN correct_aligned THEN ['aligned'] ELSE [] END || CASE WHEN correct THEN ['correct'] ELSE [] END) AS class
  FROM results WHERE logprob IS NOT NULL AND NOT isnan(logprob) AND NOT coalesce(error, false)) GROUP BY ALL""")
def score_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Nested classes as rows: a correct answer counts in four of them."""
    rows = table(spark, folder, "results").where(F.col("logprob").isNotNull() & ~F.isnan("logprob") & ~F.coalesce("error", F.lit(False)))
    classes = F.array_compact(
        F.array(F.lit("global"), F.when(F.col("correct_stripped"), "stripped").otherwise("incorrect"), F.when(F.col("correct_aligned"), "aligned"), F.when(F.col("correct"), "correct"))
    )
    long = rows.select("entry_index", "model", "logprob", F.explode(classes).alias("class"))
    return long.groupBy("entry_index", "model", "class").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("logprob") * 1000)).alias("sum_e3"))


@query("""SELECT r.patch_commit_hash AS hash, count(DISTINCT r.entry_index) AS entries, count(*) AS answers, max(e.filename) AS filename
  FROM results r JOIN test_entries e ON r.entry_index = e.entry_index AND lower(r.patch_commit_hash) = lower(e.patch_commit_hash) WHERE r.patch_commit_hash <> '' GROUP BY r.patch_commit_hash""")
def results_by_commit(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup of each answer's test case; the answers are counted per case before the join, so a hot case is one row."""
    r = table(spark, folder, "results").where("patch_commit_hash <> ''").groupBy("entry_index", "patch_commit_hash").agg(F.count("*").alias("answers"))
    e = table(spark, folder, "test_entries").select("entry_index", F.lower("patch_commit_hash").alias("low"), "filename")
    met = r.withColumn("low", F.lower("patch_commit_hash")).join(e, ["entry_index", "low"])
    return met.groupBy(F.col("patch_commit_hash").alias("hash")).agg(F.countDistinct("entry_index").alias("entries"), F.sum("answers").alias("answers"), F.max("filename").alias("filename"))


@query("""SELECT model, run_day, coalesce(model, '(none)') || ': ' || (c * 10000 // n) // 100 || '.' || lpad((((c * 10000 // n) % 100))::VARCHAR, 2, '0') || '% (' || c || '/' || n || ')' AS line
  FROM (SELECT model, run_day, count_if(correct) AS c, count(*) AS n FROM results GROUP BY model, run_day)""")
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Shares as text with two decimals, cut and not rounded, and their counts."""
    rows = table(spark, folder, "results").groupBy("model", "run_day").agg(F.count_if("correct").alias("c"), F.count("*").alias("n"))
    cents = F.expr("c * 10000 div n")
    line = F.concat(F.coalesce("model", F.lit("(none)")), F.lit(": "), F.expr("(c * 10000 div n) div 100").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("% ("), F.col("c").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")"))
    return rows.select("model", "run_day", line.alias("line"))

"""Set operations, look-ups with defaults, and groups of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import contain, graph, intervals, namesets
from millrace.plans.registry import query
from millrace.sources.tables import table


@query("SELECT entry_index FROM test_entries EXCEPT SELECT entry_index FROM results WHERE correct AND duration > 20 AND duration - duration = 0 AND entry_index IS NOT NULL")
def entries_without_slow_success(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test_entries").select("entry_index").join(table(spark, folder, "results").where(F.col("correct") & (F.col("duration") > 20) & ~F.isnan("duration")).select("entry_index"), "entry_index", "left_anti").distinct()


@query("""SELECT entry_index, max(a)::BOOLEAN AS in_a, max(b)::BOOLEAN AS in_b FROM (SELECT entry_index, 1 AS a, 0 AS b FROM checkpoint_a UNION ALL SELECT entry_index, 0, 1 FROM checkpoint_b) GROUP BY entry_index""")
def all_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The union of both key sets, with the sides that have each key."""
    side = lambda x, v: table(spark, folder, f"checkpoint_{x}").select("entry_index", F.lit(v).alias("a"))
    return side("a", True).union(side("b", False)).groupBy("entry_index").agg(F.bool_or("a").alias("in_a"), F.bool_or(~F.col("a")).alias("in_b"))


@query("""SELECT source, entry_index, model, CASE WHEN duration - duration = 0 THEN duration END AS duration, coalesce(NOT duration - duration = 0, false) AS is_nan, output_tokens
  FROM (SELECT 'a' AS source, entry_index, model, duration, NULL::BIGINT AS output_tokens FROM checkpoint_a UNION ALL SELECT 'r', entry_index, model, duration, output_tokens FROM results)""")
def bag_union(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of two tables with different columns under one another, missing columns null; NaN is null with a flag."""
    a = table(spark, folder, "checkpoint_a").select(F.lit("a").alias("source"), "entry_index", "model", "duration")
    r = table(spark, folder, "results").select(F.lit("r").alias("source"), "entry_index", "model", "duration", "output_tokens")
    nan = F.coalesce(F.isnan("duration"), F.lit(False))
    both = r.unionByName(a, allowMissingColumns=True).withColumn("is_nan", nan)
    return both.select("source", "entry_index", "model", F.when(~nan, F.col("duration")).alias("duration"), "is_nan", "output_tokens")


@query("SELECT DISTINCT commit_type, file_path FROM answers WHERE resolved_version IS NOT NULL")
def files_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "answers").where("resolved_version is not null").select("commit_type", "file_path").distinct()


@query("SELECT request_id, coalesce(n_beams, 1) AS n_beams, coalesce(endpoint_type, 'none') AS endpoint_type FROM api_requests LEFT JOIN endpoints USING (endpoint_index)")
def beams_default(spark: SparkSession, folder: str) -> DataFrame:
    """A setting by look-up, with a default."""
    e = table(spark, folder, "endpoints").select("endpoint_index", "n_beams", "endpoint_type")
    return table(spark, folder, "api_requests").join(e, "endpoint_index", "left").select("request_id", F.coalesce("n_beams", F.lit(1)).alias("n_beams"), F.coalesce("endpoint_type", F.lit("none")).alias("endpoint_type"))


@query("""WITH n AS (SELECT answer_id, file_path, local_start, list_transform(string_split(model, ','), lambda x: trim(x)) AS names FROM answers), l AS (SELECT *, lag(names) OVER (PARTITION BY file_path ORDER BY local_start, answer_id) AS before FROM n)
  SELECT answer_id, list_has_any(names, before) AS shares, list_has_all(before, names) AS contained FROM l WHERE before IS NOT NULL""")
def shared_names(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an answer shares a name with the one before it in its file, and whether all its names are among them."""
    rows = table(spark, folder, "answers").select("answer_id", "file_path", "local_start", F.transform(F.split("model", ","), lambda x: F.trim(x)).alias("names"))
    rows = intervals.with_neighbours(rows, "file_path", ["local_start", "answer_id"], {"before": "names"}).where("before is not null")
    return rows.select("answer_id", F.arrays_overlap("names", "before").alias("shares"), (F.size(F.array_except("names", "before")) == 0).alias("contained"))


@query("""WITH n AS (SELECT answer_id, file_path, local_start, list_transform(string_split(model, ','), lambda x: trim(x)) AS names FROM answers)
  SELECT a.answer_id, coalesce(bool_or(list_has_any(a.names, b.names)), false) AS shares, max_by(b.answer_id, (b.local_start, b.answer_id)) FILTER (WHERE list_has_all(b.names, a.names)) AS container
  FROM n a LEFT JOIN n b ON a.file_path = b.file_path AND (b.local_start < a.local_start OR (b.local_start = a.local_start AND b.answer_id < a.answer_id)) GROUP BY a.answer_id""")
def names_before(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an answer shares a name with any earlier one of its file, and the last earlier one that has all its names."""
    rows = table(spark, folder, "answers").select("answer_id", "file_path", "local_start", F.array_sort(F.array_distinct(F.transform(F.split("model", ","), lambda x: F.trim(x)))).alias("names"))
    return namesets.earlier_sets(rows, "file_path", "local_start", "answer_id", "names").select("answer_id", "shares", F.col("container"))


@query(r"""SELECT event_id, regexp_replace(props, '"([^"]*k[^"]*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}\]]+)', '"\1": null', 'g') AS redacted FROM events""")
def json_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Values of keys whose name holds a given text are blanked in flat JSON."""
    return table(spark, folder, "events").select("event_id", F.regexp_replace("props", r'"([^"]*k[^"]*)"\s*:\s*("(?:[^"\\]|\\.)*+"|[^,}\]]++)', '"$1": null').alias("redacted"))


_EDGES = """o AS (SELECT answer_id, file_path, local_start, lag(answer_id) OVER w AS p, max(local_end) OVER (PARTITION BY file_path ORDER BY local_start, local_end, answer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM answers
    WINDOW w AS (PARTITION BY file_path ORDER BY local_start, local_end, answer_id)),
  e AS (SELECT p AS a, answer_id AS b FROM o WHERE local_start <= reach + 10 UNION SELECT m, answer_id FROM (SELECT answer_id, min(answer_id) OVER (PARTITION BY file_path, resolved_version) AS m FROM answers WHERE resolved_version IS NOT NULL) WHERE m <> answer_id),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT a AS node, least(a, min(b)) AS root FROM s GROUP BY a UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node WHERE r.root < s.b)
  SELECT answer_id, coalesce(min(root), answer_id) AS region FROM answers LEFT JOIN r ON node = answer_id GROUP BY answer_id""")
def region_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a file in one region: ranges at most ten lines apart, or with the same text; both relations chain.

    Each range is linked to the first of its island, and each text to its first answer: at most two links a row.
    """
    rows = table(spark, folder, "answers").select("answer_id", "file_path", "local_start", "local_end", F.md5("resolved_version").alias("h"))
    opened = intervals.island_rows(rows, "file_path", "local_start", "local_end", gap=10)
    heads = opened.groupBy("file_path", "island").agg(F.min("answer_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    touch = opened.join(heads, ["file_path", "island"]).where("a <> answer_id").select("a", F.col("answer_id").alias("b"))
    texts = rows.where("h is not null")
    first = texts.groupBy("file_path", "h").agg(F.min("answer_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = texts.join(first, ["file_path", "h"]).where("a <> answer_id").select("a", F.col("answer_id").alias("b"))
    roots = graph.components(touch.unionByName(same), "a", "b")
    return rows.join(roots, F.col("node") == F.col("answer_id"), "left").select("answer_id", F.coalesce("root", "answer_id").alias("region"))


@query("""SELECT f.file_path, min(doc_id) AS doc_id FROM (SELECT DISTINCT file_path FROM answers WHERE file_path <> '') f LEFT JOIN documents d ON contains(d.text, f.file_path) GROUP BY f.file_path""")
def first_mention(spark: SparkSession, folder: str) -> DataFrame:
    """The first document that names each file of the answers."""
    return contain.first_containing(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "answers"), "file_path")

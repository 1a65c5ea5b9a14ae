"""Queries on resolved answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import consensus
from millrace.plans.registry import query
from millrace.sources.tables import table

_GROUPS = """g AS (SELECT file_path, local_start, resolved_version, count(*) AS members, sum(input_tokens) // count(input_tokens) AS input_tokens, sum(output_tokens) // count(output_tokens) AS output_tokens,
    avg(logprob) FILTER (WHERE NOT isnan(logprob)) AS logprob, max(duration) FILTER (WHERE NOT isnan(duration)) AS duration, min(endpoint_index) AS endpoint_index,
    bool_or(NOT coalesce(no_change, false)) AS adapted, min(answer_id) AS first_id
  FROM answers WHERE multi_index = 0 AND beam_index = 0 GROUP BY file_path, local_start, resolved_version),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path, local_start ORDER BY members DESC, adapted DESC, endpoint_index NULLS LAST, first_id) AS rank FROM g)"""
_COLUMNS = "file_path, local_start, md5(resolved_version) AS version, members, input_tokens, output_tokens, round(logprob, 6) AS logprob, duration, endpoint_index, adapted, first_id, rank"


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    answers = consensus.first_answers(table(spark, folder, "answers")).withColumn("version", F.md5("resolved_version"))  # digests travel, not texts
    rows = consensus.ranked(consensus.grouped(answers, "version"))
    return rows.select("file_path", "local_start", "version", "members", "input_tokens", "output_tokens", F.round("logprob", 6).alias("logprob"), "duration", "endpoint_index", "adapted", "first_id", "rank")


@query(f"WITH {_GROUPS} SELECT {_COLUMNS} FROM r")
def consensus_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder)


@query(f"WITH {_GROUPS} SELECT {_COLUMNS} FROM r WHERE rank = 1")
def consensus_top1(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).where("rank = 1")


@query(r"""WITH n AS (SELECT file_path, trim(unnest(string_split(model, ','))) AS name, answer_id FROM answers),
f AS (SELECT file_path, name, min(answer_id) AS first_at FROM n WHERE name <> '' GROUP BY file_path, name),
p AS (SELECT file_path, first_at, CASE WHEN regexp_matches(name, '(?s)^.*\([^()]*\)\s*$') THEN rtrim(regexp_extract(name, '(?s)^(.*)\(([^()]*)\)\s*$', 1)) ELSE name END AS base,
      CASE WHEN regexp_matches(name, '(?s)^.*\([^()]*\)\s*$') THEN regexp_extract(name, '(?s)^(.*)\(([^()]*)\)\s*$', 2) END AS inside FROM f),
b AS (SELECT file_path, base, min(first_at) AS first_at, string_agg(inside, '|' ORDER BY first_at, inside) AS insides FROM p GROUP BY file_path, base)
SELECT file_path, string_agg(CASE WHEN insides IS NULL THEN base ELSE base || ' (' || insides || ')' END, ', ' ORDER BY first_at, base) AS label FROM b GROUP BY file_path""")
def label_merge(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.merged_labels(table(spark, folder, "answers"), ["file_path"])


@query("SELECT min(answer_id) AS answer_id, count(*) AS copies FROM answers GROUP BY file_path, local_start, resolved_version")
def first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "answers").groupBy("file_path", "local_start", F.md5("resolved_version")).agg(F.min("answer_id").alias("answer_id"), F.count("*").alias("copies")).select("answer_id", "copies")


@query("""SELECT DISTINCT trim(unnest(string_split(model, ','))) AS name FROM answers""")
def model_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "answers").select(F.explode(F.split("model", ",")).alias("name")).select(F.trim("name").alias("name")).distinct()


@query("""SELECT DISTINCT rtrim(endpoint_name) || CASE WHEN k = 0 THEN '' ELSE ' (#' || k || ')' END AS label FROM (SELECT endpoint_name, unnest(range(0, CASE WHEN endpoint_type = 'tuned' THEN coalesce(n_beams, 1) ELSE 1 END)) AS k FROM endpoints)""")
def expected_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels that answers can have: one for each endpoint, and one more for each further beam of a tuned one."""
    beams = F.when(F.col("endpoint_type") == "tuned", F.coalesce("n_beams", F.lit(1))).otherwise(1)
    k = table(spark, folder, "endpoints").select("endpoint_name", F.explode(F.sequence(F.lit(0).cast("long"), beams - 1)).alias("k"))
    return k.select(F.concat(F.rtrim("endpoint_name"), F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit(" (#"), "k", F.lit(")")))).alias("label")).distinct()


@query("""SELECT answer_id, model || CASE WHEN x = '' THEN '' ELSE ' (' || x || ')' END AS label FROM (SELECT *, CASE WHEN variant_index > 0 THEN variant_index::VARCHAR ELSE '' END ||
  CASE WHEN beam_index > 0 THEN '#' || beam_index ELSE '' END || CASE WHEN multi_index > 0 THEN '$' || multi_index ELSE '' END AS x FROM answers)""")
def answer_labels(spark: SparkSession, folder: str) -> DataFrame:
    label = consensus.answer_label(F.col("model"), F.col("variant_index"), F.col("beam_index"), F.col("multi_index"))
    return table(spark, folder, "answers").select("answer_id", label.alias("label"))


@query("SELECT model, count(DISTINCT endpoint_index) AS endpoints FROM answers GROUP BY model HAVING count(DISTINCT endpoint_index) > 1")
def ambiguous_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "answers").groupBy("model").agg(F.countDistinct("endpoint_index").alias("endpoints")).where("endpoints > 1")


@query("""SELECT commit_type, count(*) AS conflicts, sum(greatest(1, n)) AS members, round(sum(d), 4) AS duration FROM (
  SELECT commit_type, file_path, local_start, count(resolved_version) AS n, sum(duration) FILTER (WHERE NOT isnan(duration)) AS d FROM answers GROUP BY ALL) GROUP BY commit_type""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = F.sum(F.when(~F.isnan("duration"), F.col("duration")))
    per = table(spark, folder, "answers").groupBy("commit_type", "file_path", "local_start").agg(F.count("resolved_version").alias("n"), d.alias("d"))
    return per.groupBy("commit_type").agg(F.count("*").alias("conflicts"), F.sum(F.greatest(F.lit(1), F.col("n"))).alias("members"), F.round(F.sum("d"), 4).alias("duration"))


@query("""SELECT answer_id, CASE WHEN duration > 0 AND NOT isnan(duration) THEN round((input_tokens + output_tokens) / duration, 6) END AS tokens_per_second FROM answers""")
def tokens_per_second(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.when((F.col("duration") > 0) & ~F.isnan("duration"), F.round((F.col("input_tokens") + F.col("output_tokens")) / F.col("duration"), 6))
    return table(spark, folder, "answers").select("answer_id", rate.alias("tokens_per_second"))


_PAST = "TIMESTAMP '2025-02-01 00:00:00'"
_OLD = f"old AS (SELECT file_path, local_start, min(answer_id) AS reused FROM answers WHERE answered_at < {_PAST} GROUP BY ALL), new AS (SELECT * FROM answers WHERE answered_at >= {_PAST})"


def _rounds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The first earlier answer of each place, and the later answers."""
    keys = ["file_path", "local_start"]
    rows = table(spark, folder, "answers")
    past = F.col("answered_at") < F.expr(_PAST)
    return rows.where(past).groupBy(*keys).agg(F.min("answer_id").alias("reused")), rows.where(~past), keys


@query(f"WITH {_OLD} SELECT answer_id, reused FROM new JOIN old USING (file_path, local_start)")
def reuse_previous(spark: SparkSession, folder: str) -> DataFrame:
    old, new, keys = _rounds(spark, folder)
    return new.join(old, keys).select("answer_id", "reused")


@query(f"WITH {_OLD} SELECT answer_id FROM new ANTI JOIN old USING (file_path, local_start)")
def new_work(spark: SparkSession, folder: str) -> DataFrame:
    old, new, keys = _rounds(spark, folder)
    return new.join(old, keys, "left_anti").select("answer_id")


@query(f"WITH {_OLD} SELECT answer_id, coalesce(reused, answer_id) AS used FROM new LEFT JOIN old USING (file_path, local_start)")
def reuse_left_first(spark: SparkSession, folder: str) -> DataFrame:
    old, new, keys = _rounds(spark, folder)
    return new.join(old, keys, "left").select("answer_id", F.coalesce("reused", "answer_id").alias("used"))


@query("""SELECT file_path, bool_or(resolved_version IS NULL AND commit_type <> 'Clean') AS aborted, count_if(resolved_version IS NOT NULL) AS applied FROM answers WHERE multi_index = 0 AND beam_index = 0 GROUP BY file_path""")
def aborted_files(spark: SparkSession, folder: str) -> DataFrame:
    """A place without an answer aborts its file unless it is clean."""
    rows = consensus.first_answers(table(spark, folder, "answers"))
    return rows.groupBy("file_path").agg(F.bool_or(F.col("resolved_version").isNull() & (F.col("commit_type") != "Clean")).alias("aborted"), F.count_if(F.col("resolved_version").isNotNull()).alias("applied"))


@query("""SELECT file_path, local_start, CASE WHEN list_distinct(list(commit_type)) = ['Clean'] THEN 'Clean' WHEN count_if(commit_type IN ('Conflict', 'ConflictAndClean')) = count(*) AND count_if(commit_type = 'ConflictAndClean') = 0 THEN 'Conflict'
  WHEN count_if(commit_type LIKE 'Clean%') = count(*) THEN CASE WHEN count_if(commit_type = 'Clean') > 0 THEN 'Clean' ELSE 'CleanDisabled' END ELSE 'ConflictAndClean' END AS merged FROM answers GROUP BY file_path, local_start""")
def merged_types(spark: SparkSession, folder: str) -> DataFrame:
    """The joint type of a place: clean with disabled is clean, any mix of clean and conflict is both."""
    kinds = F.collect_set("commit_type")
    has = lambda k: F.array_contains("kinds", k)
    clean = ~has("Conflict") & ~has("ConflictAndClean")
    merged = F.when(clean, F.when(has("Clean"), "Clean").otherwise("CleanDisabled")).when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise("ConflictAndClean")
    return table(spark, folder, "answers").groupBy("file_path", "local_start").agg(kinds.alias("kinds")).select("file_path", "local_start", merged.alias("merged"))


@query("""SELECT request_id, response_id, position FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY variant_index, beam_index, response_id) - 1 AS position FROM api_responses) WHERE position < 2""")
def first_beams(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy("variant_index", "beam_index", "response_id")
    return table(spark, folder, "api_responses").withColumn("position", F.row_number().over(w) - 1).where("position < 2").select("request_id", "response_id", "position")


@query("""SELECT request_id, response_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id, response ORDER BY variant_index, beam_index, response_id) AS rn FROM api_responses WHERE response IS NOT NULL) WHERE rn > 1""")
def repeated_in_request(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("request_id", "h").orderBy("variant_index", "beam_index", "response_id")
    rows = table(spark, folder, "api_responses").where("response is not null").select("request_id", "response_id", "variant_index", "beam_index", F.md5("response").alias("h"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("request_id", "response_id")


@query("""SELECT r.request_id, r.endpoint_index, min_by(p.response_id, (p.variant_index, p.beam_index, p.response_id)) FILTER (WHERE p.response IS NOT NULL) AS first_success, count(p.response) AS answers
  FROM api_requests r LEFT JOIN api_responses p ON r.request_id = p.request_id GROUP BY r.request_id, r.endpoint_index""")
def first_success(spark: SparkSession, folder: str) -> DataFrame:
    """The first response that is there, by priority; null for requests without one."""
    order = F.struct("variant_index", "beam_index", "response_id")
    there = F.col("response").isNotNull()
    best = table(spark, folder, "api_responses").groupBy("request_id").agg(F.min(F.when(there, order)).alias("best"), F.count("response").alias("answers"))
    joined = table(spark, folder, "api_requests").join(best, "request_id", "left")
    return joined.select("request_id", "endpoint_index", F.col("best.response_id").alias("first_success"), F.coalesce("answers", F.lit(0)).alias("answers"))


@query("""SELECT conflict_id, bool_and(a = 0) AND bool_or(p) AS retry, sum(a) AS answers FROM (SELECT r.request_id, r.conflict_id, coalesce(e.is_primary, false) AS p, count(x.response) AS a
  FROM api_requests r LEFT JOIN endpoints e USING (endpoint_index) LEFT JOIN api_responses x USING (request_id) GROUP BY ALL) GROUP BY conflict_id""")
def retry_flags(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "api_responses").groupBy("request_id").agg(F.count("response").alias("a"))
    primary = table(spark, folder, "endpoints").select("endpoint_index", "is_primary")
    rows = table(spark, folder, "api_requests").select("request_id", "conflict_id", "endpoint_index").join(counts, "request_id", "left").join(primary, "endpoint_index", "left")
    a, p = F.coalesce("a", F.lit(0)), F.coalesce("is_primary", F.lit(False))
    return rows.groupBy("conflict_id").agg((F.bool_and(a == 0) & F.bool_or(p)).alias("retry"), F.sum(a).alias("answers"))


@query("""SELECT conflict_id, c.endpoint_index, e.endpoint_index AS candidate FROM (SELECT DISTINCT conflict_id, endpoint_index FROM api_requests) c JOIN endpoints e ON e.is_primary AND e.endpoint_type = (SELECT endpoint_type FROM endpoints x WHERE x.endpoint_index = c.endpoint_index)""")
def primary_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of conflict and endpoint with the primary endpoints of the same type."""
    e = table(spark, folder, "endpoints")
    asked = table(spark, folder, "api_requests").select("conflict_id", "endpoint_index").distinct()
    typed = asked.join(e.select("endpoint_index", "endpoint_type"), "endpoint_index")
    return typed.join(e.where("is_primary").select(F.col("endpoint_index").alias("candidate"), "endpoint_type"), "endpoint_type").select("conflict_id", "endpoint_index", "candidate")


@query("""WITH p AS (SELECT file_path, local_start, bool_and(commit_type = 'Clean') AS clean FROM answers GROUP BY ALL), a AS (SELECT file_path, local_start, min(answer_id) AS answer_id FROM answers WHERE resolved_version IS NOT NULL AND multi_index = 0 AND beam_index = 0 GROUP BY ALL),
  j AS (SELECT p.*, answer_id FROM p LEFT JOIN a USING (file_path, local_start)), f AS (SELECT file_path FROM j GROUP BY file_path HAVING NOT bool_or(answer_id IS NULL AND NOT clean))
  SELECT file_path, local_start, answer_id FROM j SEMI JOIN f USING (file_path) WHERE answer_id IS NOT NULL""")
def applied_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The first answer of every place, for files in which no place but a clean one lacks an answer; such a one is skipped."""
    rows = table(spark, folder, "answers")
    places = rows.groupBy("file_path", "local_start").agg(F.bool_and(F.col("commit_type") == "Clean").alias("clean"))
    first = consensus.first_answers(rows).where("resolved_version is not null").groupBy("file_path", "local_start").agg(F.min("answer_id").alias("answer_id"))
    joined = places.join(first, ["file_path", "local_start"], "left")
    whole = joined.groupBy("file_path").agg(F.bool_or(F.col("answer_id").isNull() & ~F.col("clean")).alias("aborted")).where("not aborted").select("file_path")
    return joined.where("answer_id is not null").join(whole, "file_path", "left_semi").select("file_path", "local_start", "answer_id")


_PLACE = ["file_path", "local_start", "local_end"]


@query("""WITH old AS (SELECT file_path, local_start, local_end, answer_id AS reused FROM answers WHERE endpoint_index % 2 = 0), new AS (SELECT * FROM answers WHERE endpoint_index % 2 <> 0)
  SELECT answer_id, reused, false AS fresh FROM new JOIN old USING (file_path, local_start, local_end) UNION ALL SELECT answer_id, NULL, true FROM new ANTI JOIN old USING (file_path, local_start, local_end)""")
def reuse_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Answers at a place that other endpoints have answered take all of their answers; the others are new work."""
    rows = table(spark, folder, "answers")
    old = rows.where("endpoint_index % 2 = 0").select(*_PLACE, F.col("answer_id").alias("reused"))
    new = rows.where("endpoint_index % 2 <> 0").select(*_PLACE, "answer_id")
    fresh = new.join(old, _PLACE, "left_anti").select("answer_id", F.lit(None).cast("long").alias("reused"), F.lit(True).alias("fresh"))
    return new.join(old, _PLACE).select("answer_id", "reused", F.lit(False).alias("fresh")).unionByName(fresh)


@query("""SELECT endpoint_index, replace(CASE WHEN len(endpoint_name) - len(replace(endpoint_name, '(', '')) = 1 THEN replace(endpoint_name, '(', chr(10) || '(') ELSE endpoint_name END, '+', chr(10) || '+') AS label FROM endpoints""")
def chart_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names over several lines: a single bracket and every plus sign start a line."""
    one = F.regexp_count("endpoint_name", F.lit(r"\(")) == 1
    broken = F.when(one, F.replace("endpoint_name", F.lit("("), F.lit("\n("))).otherwise(F.col("endpoint_name"))
    return table(spark, folder, "endpoints").select("endpoint_index", F.replace(broken, F.lit("+"), F.lit("\n+")).alias("label"))


@query("""SELECT entry_index, coalesce(code, '') = '' AS missing, CASE WHEN code <> '' THEN md5(CASE WHEN ends_with(code, chr(10)) THEN code ELSE code || chr(10) END) END AS blob FROM test_entries""")
def blob_read(spark: SparkSession, folder: str) -> DataFrame:
    """Contents as they are read: an empty one is an error, and a final line end is added where there is none."""
    whole = F.when(F.col("code").endswith("\n"), F.col("code")).otherwise(F.concat("code", F.lit("\n")))
    return table(spark, folder, "test_entries").select("entry_index", (F.coalesce("code", F.lit("")) == "").alias("missing"), F.when(F.col("code") != "", F.md5(whole)).alias("blob"))

"""Queries on state, configuration, nested values, regions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diffs, regions, state, validate
from millrace.plans.registry import query
from millrace.sources.csv import RESULT_SCHEMA, commit_pairs, description_parts, read_results, status_entries, write_results
from millrace.sources.tables import table
from millrace.storage import shared_dir
from millrace.streaming import results as streaming

_KEYED = "SELECT entry_index, lower(trim(model)) AS model_key, correct, correct_aligned, correct_stripped, recorded_at"


@query(f"""SELECT entry_index, model_key, correct, correct_aligned, correct_stripped, epoch_us(recorded_at) AS recorded_us, source FROM (SELECT *, row_number() OVER (PARTITION BY entry_index, model_key ORDER BY source DESC, recorded_at DESC NULLS LAST,
    correct DESC NULLS LAST, correct_aligned DESC NULLS LAST, correct_stripped DESC NULLS LAST) AS rn FROM ({_KEYED}, 0 AS source FROM checkpoint_a UNION ALL {_KEYED}, 1 FROM checkpoint_b)) WHERE rn = 1""")
def upsert_import(spark: SparkSession, folder: str) -> DataFrame:
    """The second system's rows win; within a system the latest."""
    columns = [F.col("entry_index"), F.lower(F.trim("model")).alias("model_key"), *map(F.col, ("correct", "correct_aligned", "correct_stripped", "recorded_at"))]
    a, b = (table(spark, folder, f"checkpoint_{x}").select(*columns) for x in "ab")
    return state.upsert([a, b], ["entry_index", "model_key"], order=["recorded_at"]).withColumn("recorded_us", F.unix_micros("recorded_at")).drop("recorded_at")


@query("""WITH c AS (SELECT md5(coalesce(patch, '') || coalesce(code, '')) AS key, min(entry_index) AS value FROM test_entries GROUP BY 1)
  SELECT entry_index, value, value IS NOT NULL AS hit FROM test_entries e LEFT JOIN c ON c.key = md5(coalesce(e.patch, '') || coalesce(e.code, ''))""")
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that a cache keyed by content would answer with the first entry of equal content."""
    key = F.md5(F.concat(F.coalesce("patch", F.lit("")), F.coalesce("code", F.lit(""))))
    rows = table(spark, folder, "test_entries").select("entry_index", key.alias("key"))
    return state.cached(rows, rows.groupBy("key").agg(F.min("entry_index").alias("value")), "key").select("entry_index", "value", "hit")


@query(r"""WITH n AS (SELECT *, regexp_replace(endpoint_name, '^\s+|\s+$', '', 'g') AS nm FROM endpoints), bad AS (
  SELECT endpoint_index, 'name_empty' AS rule FROM n WHERE coalesce(nm, '') = '' UNION ALL SELECT endpoint_index, 'name_untrimmed' FROM n WHERE nm <> endpoint_name
  UNION ALL SELECT endpoint_index, 'name_characters' FROM n WHERE regexp_matches(nm, '[,()#$|\n\t]') UNION ALL SELECT endpoint_index, 'url_empty' FROM n WHERE coalesce(url, '') = ''
  UNION ALL SELECT endpoint_index, 'delay_range' FROM n WHERE max_delay < delay UNION ALL SELECT endpoint_index, 'name_repeated' FROM (SELECT *, count(*) OVER (PARTITION BY nm) AS c FROM n) WHERE c > 1)
  SELECT b.endpoint_index, rule, count(r.request_id) AS requests FROM bad b LEFT JOIN api_requests r ON r.endpoint_index = b.endpoint_index GROUP BY b.endpoint_index, rule""")
def endpoint_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Broken rules of endpoints with the number of requests they touch."""
    asked = table(spark, folder, "api_requests").groupBy("endpoint_index").agg(F.count("*").alias("requests"))
    return validate.endpoint_rules(table(spark, folder, "endpoints")).join(asked, "endpoint_index", "left").select("endpoint_index", "rule", F.coalesce("requests", F.lit(0)).alias("requests"))


@query("""SELECT e.endpoint_index, coalesce(is_primary, false) OR NOT (SELECT coalesce(bool_or(is_primary), false) FROM endpoints) AS "primary", count(a.answer_id) AS answers FROM endpoints e LEFT JOIN answers a ON a.endpoint_index = e.endpoint_index GROUP BY ALL""")
def primary_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "answers").groupBy("endpoint_index").agg(F.count("*").alias("answers"))
    rows = validate.primaries(table(spark, folder, "endpoints").select("endpoint_index", "is_primary"))
    return rows.join(given, "endpoint_index", "left").select("endpoint_index", "primary", F.coalesce("answers", F.lit(0)).alias("answers"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS fallback FROM events")
def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    """A value by path, with a second path where the first is not there."""
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "bigint")
    return table(spark, folder, "events").select("event_id", k.alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.try_variant_get(v, "$.k", "string")).alias("fallback"))


@query("""SELECT response_id, CASE WHEN response IS NULL THEN 'missing' WHEN output_tokens IS NULL THEN 'no_usage' WHEN logprob IS NULL OR isnan(logprob) THEN 'no_score' WHEN duration = 0 THEN 'cached' ELSE 'complete' END AS class,
  greatest(output_tokens - coalesce(input_tokens, 0), 0) AS tokens_over FROM api_responses""")
def response_class(spark: SparkSession, folder: str) -> DataFrame:
    """The first class that fits, and a difference floored at zero."""
    kind = (
        F.when(F.col("response").isNull(), "missing").when(F.col("output_tokens").isNull(), "no_usage").when(F.col("logprob").isNull() | F.isnan("logprob"), "no_score").when(F.col("duration") == 0, "cached").otherwise("complete")
    )
    over = F.when(F.col("output_tokens").isNotNull(), F.greatest(F.col("output_tokens") - F.coalesce("input_tokens", F.lit(0)), F.lit(0))).otherwise(F.lit(0))
    return table(spark, folder, "api_responses").select("response_id", kind.alias("class"), over.alias("tokens_over"))


@query(r"""WITH f AS (SELECT record_id, regexp_extract_all(',' || raw_text, ',((?:"(?:[^"]|"")*")|[^",]*)', 1) AS f FROM raw_entries), d AS (SELECT record_id, trim(f[3], '"') AS d FROM f)
  SELECT record_id, CASE WHEN contains(d, ' / ') THEN left(d, instr(d, ' / ') - 1) ELSE d END || '^' AS code_commit_hash,
    CASE WHEN contains(d, ' / ') THEN split_part(substr(d, instr(d, ' / ') + 3), chr(10), 1) ELSE '' END AS patch_commit_hash, CASE WHEN contains(d, ' / ') THEN split_part(substr(d, instr(d, ' / ') + 3), chr(10), 2) ELSE '' END AS filename FROM d WHERE d IS NOT NULL""")
def description_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes and file name from the description field."""
    third = F.get(F.regexp_extract_all(F.concat(F.lit(","), F.col("raw_text")), F.lit(r',((?:"(?:[^"]++|"")*+")|[^",]*+)'), F.lit(1)), F.lit(2))
    rows = table(spark, folder, "raw_entries").select("record_id", F.btrim(third, F.lit('"')).alias("d")).where("d is not null")
    return rows.select("record_id", *(c.alias(n) for c, n in zip(description_parts(F.col("d")), ("code_commit_hash", "patch_commit_hash", "filename"), strict=True)))


@query("""WITH e AS (SELECT entry_index, CASE WHEN code = '' OR ends_with(code, chr(10)) THEN code ELSE code || chr(10) END AS a, CASE WHEN patched_code = '' OR ends_with(patched_code, chr(10)) THEN patched_code ELSE patched_code || chr(10) END AS b FROM test_entries
    WHERE code IS NOT NULL AND patched_code IS NOT NULL AND NOT regexp_matches(code || chr(10) || patched_code, '(?m)^(?:<{7}|={7}|>{7}|\\|{7})'))
  SELECT entry_index, md5('head' || chr(10) || a || 'tail' || chr(10)) AS upper, md5('head' || chr(10) || b || 'tail' || chr(10)) AS lower, 1 AS n_regions FROM e""")
def region_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Code and patched code written as one marked region, parsed again: each side of the text equals what went in."""
    ended = lambda c: F.when((F.col(c) == "") | F.col(c).endswith("\n"), F.col(c)).otherwise(F.concat(F.col(c), F.lit("\n")))
    rows = table(spark, folder, "test_entries").where("code is not null and patched_code is not null")
    rows = rows.where(~F.concat_ws("\n", "code", "patched_code").rlike(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})"))
    text = F.concat(F.lit("head\n<<<<<<< ours\n"), ended("code"), F.lit("=======\n"), ended("patched_code"), F.lit(">>>>>>> theirs\ntail\n"))
    marked = rows.select("entry_index", text.alias("t"))
    return marked.select("entry_index", F.md5(regions.one_side(F.col("t"), "upper")).alias("upper"), F.md5(regions.one_side(F.col("t"), "lower")).alias("lower"), F.size(regions.regions(F.col("t"))).alias("n_regions"))


@query(r"""WITH l AS (SELECT request_id, regexp_extract_all(code, '[^\n]*\n|[^\n]+') AS ls FROM api_requests WHERE code IS NOT NULL)
  SELECT request_id, md5(CASE WHEN len(ls) >= 2 THEN '/* cut */' || chr(10) || array_to_string(ls[3:], '') ELSE array_to_string(ls, '') END) AS spliced FROM l""")
def splice_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first two lines of every code with at least two replaced by one."""
    files = table(spark, folder, "api_requests").where("code is not null").select("request_id", "code")
    long = files.where(F.size(F.regexp_extract_all("code", F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))) >= 2)
    edits = long.select("request_id", F.lit(0).cast("long").alias("start"), F.lit(2).cast("long").alias("end"), F.lit("/* cut */\n").alias("replacement"))
    return regions.spliced(files, edits, "request_id", "code").select("request_id", F.md5("code").alias("spliced"))


@query()
def entry_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """The diff from code to patched code of every test case."""
    return diffs.line_diffs(table(spark, folder, "test_entries"), "entry_index", "code", "patched_code", n=3)


@query(r"""SELECT entry_index, md5(code) AS base, md5(patched_code) AS remote, (length(code) - length(replace(code, chr(10), '')) + (code <> '' AND NOT ends_with(code, chr(10)))::INT)::BIGINT AS base_lines FROM test_entries WHERE patched_code IS NOT NULL AND code <> '' AND patched_code <> ''""")
def diff_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of every test case, put together again from the lines of their difference."""
    rows = table(spark, folder, "test_entries").where("code <> '' and patched_code <> ''")
    script = diffs.line_script(rows, "entry_index", "code", "patched_code")
    side = lambda sign: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("sign") != sign, F.struct("pos", "line")))), lambda x: x["line"]), ""))
    return script.groupBy("entry_index").agg(side("+").alias("base"), side("-").alias("remote"), F.count_if(F.col("sign") != "+").alias("base_lines"))


@query("SELECT model, run_day, count(*) AS answers, count_if(correct) AS n_correct, count_if(error) AS n_error FROM results GROUP BY model, run_day")
def stream_model_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The running counts of a stream over the result files, after its last batch."""
    place = f"{shared_dir(spark)}/millrace/stream-{uuid.uuid4().hex}"
    streaming.run_counts(streaming.read_stream(spark, folder, "results"), f"{place}/out", f"{place}/state")
    return streaming.total_counts(spark, f"{place}/out")


_ROUND = "entry_index, model, correct, correct_aligned, error, input_tokens, output_tokens, md5(failed_patched_code) AS failed"


@query(f"SELECT {_ROUND} FROM results")
def results_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The results written as a checkpoint folder and read again, texts over several lines and empty ones included."""
    path = f"{shared_dir(spark)}/millrace/checkpoint-{uuid.uuid4().hex}"
    rows = table(spark, folder, "results")
    write_results(rows.select(*(c.split(" ")[0] for c in RESULT_SCHEMA.split(", "))), path)
    return read_results(spark, path).selectExpr(*_ROUND.split(", "))


@query(r"""WITH e AS (SELECT filename, entry_index, lower(patch_commit_hash) AS c, lower(replace(code_commit_hash, '^', '')) AS u FROM test_entries WHERE regexp_full_match(lower(patch_commit_hash), '[0-9a-f]{40}') AND regexp_full_match(lower(replace(code_commit_hash, '^', '')), '[0-9a-f]{40}'))
  SELECT filename, c AS commit, min_by(u, entry_index) AS upstream FROM e WHERE entry_index % 3 <> 2 GROUP BY filename, c""")
def upstream_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Commits and the upstream commits that their log entries name, read from a log of each file in which a third has no note."""
    bare = lambda c: F.lower(F.replace(c, F.lit("^"), F.lit("")))
    e = table(spark, folder, "test_entries").select("filename", "entry_index", bare(F.col("patch_commit_hash")).alias("c"), bare(F.col("code_commit_hash")).alias("u")).where(F.col("c").rlike("^[0-9a-f]{40}$") & F.col("u").rlike("^[0-9a-f]{40}$"))
    k = F.col("entry_index") % 3
    note = F.when(k == 0, F.concat(F.lit("    commit "), "u", F.lit(" upstream."))).when(k == 1, F.concat(F.lit("    [ Upstream commit "), "u", F.lit(" ]"))).otherwise("    no note")
    lines = e.select("filename", "entry_index", F.posexplode(F.array(F.concat(F.lit("commit "), "c"), F.lit("    Fix a part"), note, F.lit(f"    commit {'0' * 40} upstream."))).alias("at", "line")).where((F.col("at") < 3) | (k != 2))
    return commit_pairs(lines.withColumn("number", F.col("entry_index") * 4 + F.col("at")), "number", "line", "filename")


@query("SELECT file_path AS path, md5(file_path) AS hash FROM (SELECT DISTINCT file_path FROM answers WHERE commit_type = 'Conflict' AND file_path IS NOT NULL)")
def unmerged_files(spark: SparkSession, folder: str) -> DataFrame:
    """The unmerged entries of a status listing parted by NUL that holds other entries too."""
    path = f"{shared_dir(spark)}/millrace/status-{uuid.uuid4().hex}"
    files = table(spark, folder, "answers").where("file_path is not null").groupBy("file_path").agg(F.bool_or(F.col("commit_type") == "Conflict").alias("open"))
    line = F.when(F.col("open"), F.concat(F.lit("u UU N... 100644 100644 100644 100644 "), F.md5(F.concat(F.lit("b"), "file_path")), F.lit(" "), F.md5("file_path"), F.lit(" "), F.md5("file_path"), F.lit(" "), "file_path"))
    other = F.concat(F.lit("1 .M N... 100644 100644 100644 x y "), "file_path")
    files.select(F.coalesce(line, other).alias("value")).write.option("lineSep", "\0").text(path)
    return status_entries(spark, path)

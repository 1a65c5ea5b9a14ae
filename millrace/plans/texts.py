"""Queries on texts, diffs and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import diffs, hunks
from millrace.plans.registry import query
from millrace.sources.tables import table

_WS = r"[\t-\r \x{85}\pZ]"


@query(rf"SELECT doc_id, md5(regexp_replace(text, '{_WS}+', '', 'g')) AS stripped FROM documents WHERE text IS NOT NULL")
def stripped_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(tx.without_space(F.col("text"))).alias("stripped"))


@query(rf"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\t-\r \x{{85}}\pZ]')),
  lambda x: regexp_extract(x, '^{_WS}*') || regexp_replace(regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', ''), '{_WS}+', ' ', 'g')), chr(10))) AS aligned FROM documents WHERE text IS NOT NULL""")
def aligned_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(tx.aligned(F.col("text"))).alias("aligned"))


_BLOCKS = r"regexp_extract_all(response, '(?s)<\|patched_code\|>\n(.*?)<\|/patched_code\|>', 1)"


@query(f"SELECT response_id, len(b) AS n_blocks, md5(b[1]) AS first_block FROM (SELECT response_id, {_BLOCKS} AS b FROM api_responses WHERE response IS NOT NULL)")
def block_extract(spark: SparkSession, folder: str) -> DataFrame:
    b = tx.blocks(F.col("response"), "patched_code")
    return table(spark, folder, "api_responses").where("response is not null").select("response_id", F.size(b).alias("n_blocks"), F.md5(F.get(b, F.lit(0))).alias("first_block"))


def _first_blocks(spark: SparkSession, folder: str) -> DataFrame:
    first = F.get(tx.blocks(F.col("response"), "patched_code"), F.lit(0)).alias("block")
    answers = table(spark, folder, "api_responses").select("response_id", "request_id", first).where("block is not null")
    return answers.join(table(spark, folder, "api_requests").select("request_id", "patch", "code"), "request_id")


_JOINED = f"j AS (SELECT response_id, block, patch, code FROM (SELECT response_id, request_id, {_BLOCKS}[1] AS block FROM api_responses) JOIN api_requests USING (request_id) WHERE block IS NOT NULL)"


@query(rf"WITH {_JOINED} SELECT response_id, regexp_matches(block, '(?m)^[+\-]') AND NOT regexp_matches(code, '(?m)^[+\-]') AS like_patch FROM j")
def looks_like_patch(spark: SparkSession, folder: str) -> DataFrame:
    return _first_blocks(spark, folder).select("response_id", tx.looks_like_patch(F.col("block"), F.col("code")).alias("like_patch"))


@query(rf"""WITH {_JOINED}, l AS (SELECT *, regexp_extract_all(code, '[^\n]*\n|[^\n]+') AS ls FROM j)
  SELECT response_id, starts_with(block, array_to_string(ls[1:2], '')) AND ends_with(block, array_to_string(ls[greatest(len(ls) - 1, 1):], '')) AS in_context FROM l""")
def context_check(spark: SparkSession, folder: str) -> DataFrame:
    return _first_blocks(spark, folder).select("response_id", tx.starts_and_ends(F.col("block"), F.col("code"), 2).alias("in_context"))


_PART = "strlen(coalesce({0}, ''))::VARCHAR || coalesce({0}, '')"


@query(f"SELECT request_id, sha256({' || '.join(_PART.format(c) for c in ('prompt', 'patch', 'code', 'git_diff'))}) AS key FROM api_requests")
def cache_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "api_requests").select("request_id", tx.content_key(*(F.col(c) for c in ("prompt", "patch", "code", "git_diff"))).alias("key"))


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_no FROM documents)
  SELECT doc_id, line_no, md5(line) AS line, (sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY line_no) - strlen(line))::BIGINT AS byte_start FROM l""")
def line_explode(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every document with the byte position of each."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(tx.lines_of(F.col("text"))).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    size = F.octet_length("line")
    return lines.select("doc_id", "line_no", F.md5("line").alias("line"), (F.sum(size).over(w) - size).alias("byte_start"))


@query(r"SELECT entry_index, len(regexp_extract_all(code, '\n')) AS code_lines, len(regexp_extract_all(patched_code, '\n')) AS patched_lines, strlen(code) AS code_bytes FROM test_entries")
def newline_counts(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda c: F.regexp_count(c, F.lit("\n"))
    return table(spark, folder, "test_entries").select("entry_index", count("code").alias("code_lines"), count("patched_code").alias("patched_lines"), F.octet_length("code").alias("code_bytes"))


_HEAD = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
_LINES = rf"""raw AS (SELECT entry_index, CASE WHEN patch = '' THEN [] ELSE string_split(regexp_replace(patch, '\n\z', ''), chr(10)) END AS ls FROM test_entries WHERE patch IS NOT NULL),
l AS (SELECT entry_index, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM raw),
h AS (SELECT *, (sum(regexp_matches(line, '{_HEAD}')::INT) OVER (PARTITION BY entry_index ORDER BY pos))::BIGINT AS hunk FROM l)"""


@query(rf"""WITH {_LINES}, g AS (SELECT entry_index, hunk, max(line) FILTER (WHERE regexp_matches(line, '{_HEAD}')) AS header,
    count_if(line[1] = ' ') AS context, count_if(line[1] = '-') AS removed, count_if(line[1] = '+') AS added,
    count_if(line[1] NOT IN (' ', '-', '+', chr(92)) AND NOT regexp_matches(line, '{_HEAD}')) AS other FROM h WHERE hunk > 0 GROUP BY entry_index, hunk),
  n AS (SELECT entry_index, hunk, regexp_extract(header, '{_HEAD}', 1)::BIGINT AS base_start, coalesce(TRY_CAST(nullif(regexp_extract(header, '{_HEAD}', 2), '') AS BIGINT), 1) AS base_len,
    regexp_extract(header, '{_HEAD}', 3)::BIGINT AS remote_start, coalesce(TRY_CAST(nullif(regexp_extract(header, '{_HEAD}', 4), '') AS BIGINT), 1) AS remote_len, context, removed, added, other FROM g)
  SELECT *, context + removed = base_len AND context + added = remote_len AND other = 0 AS valid FROM n""")
def diff_to_hunks(spark: SparkSession, folder: str) -> DataFrame:
    return hunks.hunks(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch")


@query(rf"""WITH {_LINES}, c AS (SELECT *, coalesce((pos - lag(pos) OVER w > 2)::INT, 0) AS apart FROM h WHERE hunk > 0 AND line[1] IN ('+', '-') WINDOW w AS (PARTITION BY entry_index, hunk ORDER BY pos)),
  r AS (SELECT *, (sum(apart) OVER (PARTITION BY entry_index, hunk ORDER BY pos) + 1)::BIGINT AS run FROM c)
  SELECT entry_index, hunk, run, min(pos) AS first, max(pos) AS last, count(*) AS changes FROM r GROUP BY entry_index, hunk, run""")
def hunk_split(spark: SparkSession, folder: str) -> DataFrame:
    return hunks.change_runs(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch", 2)


@query(rf"""WITH {_LINES}, b AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS behind FROM h WHERE hunk > 0 AND NOT regexp_matches(line, '{_HEAD}') WINDOW w AS (PARTITION BY entry_index, hunk ORDER BY pos))
  SELECT entry_index, hunk, pos, md5(line) AS line, md5(before) AS before, md5(behind) AS behind FROM b WHERE line[1] IN ('+', '-')""")
def context_frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = hunks.neighbours(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch")
    return rows.select("entry_index", "hunk", "pos", *(F.md5(c).alias(c) for c in ("line", "before", "behind")))


def _side(signs: str) -> str:
    keep = " OR ".join(f"x[1] = '{s}'" for s in signs)
    return f"array_to_string(list_transform(list_filter(ls, lambda x: {keep}), lambda x: x[2:]), chr(10))"


@query(rf"""WITH {_LINES} SELECT entry_index, md5({_side(' -')}) AS base, md5({_side(' +')}) AS remote,
  len(list_filter(ls, lambda x: x[1] = '-')) AS removed, len(list_filter(ls, lambda x: x[1] = '+')) AS added FROM raw""")
def diff_sides(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("patch")
    count = lambda s: F.size(F.filter(tx.bare_lines(p), lambda x: x.startswith(s)))
    return table(spark, folder, "test_entries").where("patch is not null").select("entry_index", F.md5(tx.side_of(p, " -")).alias("base"), F.md5(tx.side_of(p, " +")).alias("remote"), count("-").alias("removed"), count("+").alias("added"))


@query(rf"""WITH {_LINES}, b AS (SELECT entry_index, list_transform(list_filter(ls, lambda x: NOT starts_with(x, '@@')), lambda x: x[1] IN ('+', '-')) AS c FROM raw)
  SELECT entry_index, nullif(coalesce(list_position(c, true), 0), 0) - 1 AS head, nullif(coalesce(list_position(list_reverse(c), true), 0), 0) - 1 AS tail FROM b""")
def context_sizes(spark: SparkSession, folder: str) -> DataFrame:
    head, tail = tx.context_sizes(F.col("patch"))
    return table(spark, folder, "test_entries").where("patch is not null").select("entry_index", head.alias("head"), tail.alias("tail"))


@query(rf"""WITH {_LINES} SELECT entry_index, sha256(array_to_string(list_transform(list_filter(ls, lambda x: x[1] = '-'), lambda x: strlen(x)::VARCHAR || x), '')) AS key FROM raw""")
def removed_lines_key(spark: SparkSession, folder: str) -> DataFrame:
    """A running key over the removed lines, each with its length before it."""
    minus = F.filter(tx.bare_lines(F.col("patch")), lambda x: x.startswith("-"))
    key = F.sha2(F.array_join(F.transform(minus, lambda x: F.concat(F.octet_length(x).cast("string"), x)), ""), 256)
    return table(spark, folder, "test_entries").where("patch is not null").select("entry_index", key.alias("key"))


@query(rf"""WITH {_LINES}, n AS (SELECT r.entry_index, list_filter(ls, lambda x: x[1] IN (' ', '-'))[1][2:] AS needle, chr(10) || code AS hay FROM raw r JOIN test_entries e ON r.entry_index = e.entry_index)
  SELECT entry_index, CASE WHEN needle <> '' AND (length(hay) - length(replace(hay, chr(10) || needle, ''))) / length(chr(10) || needle) = 1 THEN instr(hay, chr(10) || needle) - 1 END AS position FROM n""")
def unique_position(spark: SparkSession, folder: str) -> DataFrame:
    """Where the first base line of each patch begins a line of the code, if in one place only."""
    first = F.get(F.filter(tx.bare_lines(F.col("patch")), lambda x: x.startswith(" ") | x.startswith("-")), F.lit(0))
    needle = F.substr(first, F.lit(2))
    return table(spark, folder, "test_entries").where("patch is not null").select("entry_index", tx.line_start(needle, F.col("code")).alias("position"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  SELECT doc_id, pos, regexp_extract(line, '^([A-Za-z-]+): (.*)$', 1) AS key, rtrim(regexp_extract(line, '^([A-Za-z-]+): ([^\r]*)', 2)) AS value FROM l WHERE regexp_matches(line, '^[A-Z][A-Za-z-]+: ')""")
def trailers(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled lines (trailers, report lines) as rows."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike("^[A-Z][A-Za-z-]+: "))
    part = lambda i: F.regexp_extract("line", r"^([A-Za-z-]+): ([^\r]*)", i)
    return lines.select("doc_id", "pos", part(1).alias("key"), F.rtrim(part(2)).alias("value"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[A-Za-z-]+: [0-9.]+% \([0-9]+/[0-9]+\)')) AS line FROM documents)
  SELECT doc_id, regexp_extract(line, '^([A-Za-z-]+)', 1) AS measure, regexp_extract(line, '\(([0-9]+)/', 1)::BIGINT AS part, regexp_extract(line, '/([0-9]+)\)', 1)::BIGINT AS whole FROM m""")
def report_scrape(spark: SparkSession, folder: str) -> DataFrame:
    """Shares with their counts, read from report lines."""
    found = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[A-Za-z-]+: [0-9.]+% \([0-9]+/[0-9]+\)"), F.lit(0))).alias("line"))
    return found.select("doc_id", F.regexp_extract("line", "^([A-Za-z-]+)", 1).alias("measure"), F.regexp_extract("line", r"\(([0-9]+)/", 1).cast("long").alias("part"), F.regexp_extract("line", r"/([0-9]+)\)", 1).cast("long").alias("whole"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
  h AS (SELECT *, last_value(CASE WHEN starts_with(line, '# ') THEN rtrim(line[3:], chr(13)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM l)
  SELECT doc_id, heading, count(*) AS lines, min(pos) AS first_line FROM h GROUP BY doc_id, heading""")
def carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Lines under each heading: the last heading is carried forward line by line."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    own = F.when(F.col("line").startswith("# "), F.regexp_replace(F.substr("line", F.lit(3)), r"\r+\z", ""))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines.withColumn("heading", F.last(own, ignorenulls=True).over(w)).groupBy("doc_id", "heading").agg(F.count("*").alias("lines"), F.min("pos").alias("first_line"))


@query("""SELECT request_id, md5(concat_ws(chr(10) || chr(10), prompt, patch, code, git_diff)) AS chat, (prompt IS NOT NULL)::INT + (patch IS NOT NULL)::INT + (code IS NOT NULL)::INT + (git_diff IS NOT NULL)::INT AS parts FROM api_requests""")
def chat_assembly(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("prompt", "patch", "code", "git_diff")
    parts = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col("prompt").isNotNull().cast("int"))
    return table(spark, folder, "api_requests").select("request_id", F.md5(F.concat_ws("\n\n", *columns)).alias("chat"), parts.alias("parts"))


@query("""SELECT request_id, git_diff IS NOT NULL AND contains(git_diff, regexp_extract(prompt, '[a-z]+(?:/[a-z]+)+\\.[A-Za-z]+')) AND regexp_matches(prompt, '[a-z]+(?:/[a-z]+)+\\.[A-Za-z]+') AS attached FROM api_requests WHERE prompt IS NOT NULL""")
def diff_attached(spark: SparkSession, folder: str) -> DataFrame:
    """A diff is of use if it names the file that the prompt is about."""
    path = F.regexp_extract("prompt", r"[a-z]+(?:/[a-z]+)+\.[A-Za-z]+", 0)
    return table(spark, folder, "api_requests").where("prompt is not null").select("request_id", (F.col("git_diff").isNotNull() & F.coalesce(F.col("git_diff").contains(path), F.lit(False)) & (path != "")).alias("attached"))


_PARTS = rf"""{_LINES}, x AS (SELECT *, line[1] IN ('+', '-') AS changed FROM h WHERE hunk > 0 AND NOT regexp_matches(line, '{_HEAD}') AND NOT starts_with(line, chr(92))),
  y AS (SELECT *, coalesce(sum((line[1] <> '+')::INT) OVER p, 0) AS bb, coalesce(sum((line[1] <> '-')::INT) OVER p, 0) AS rb, max(CASE WHEN changed THEN pos END) OVER p AS last, min(CASE WHEN changed THEN pos END) OVER f AS next FROM x
    WINDOW p AS (PARTITION BY entry_index, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY entry_index, hunk ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  z AS (SELECT *, greatest(sum((changed AND (last IS NULL OR pos - last > 2))::INT) OVER (PARTITION BY entry_index, hunk ORDER BY pos), 1) AS part FROM y),
  w AS (SELECT * EXCLUDE (part), unnest(CASE WHEN last IS NOT NULL AND next IS NOT NULL AND NOT changed AND next - last > 2 THEN [part, part + 1] ELSE [part] END)::BIGINT AS part FROM z),
  s AS (SELECT entry_index, hunk, regexp_extract(line, '{_HEAD}', 1)::BIGINT AS b0, regexp_extract(line, '{_HEAD}', 3)::BIGINT AS r0 FROM h WHERE regexp_matches(line, '{_HEAD}'))"""


@query(rf"""WITH {_PARTS} SELECT entry_index, hunk, part, (b0 + min(bb))::BIGINT AS base_start, sum((line[1] <> '+')::INT)::BIGINT AS base_len, (r0 + min(rb))::BIGINT AS remote_start, sum((line[1] <> '-')::INT)::BIGINT AS remote_len, md5(string_agg(line, chr(10) ORDER BY pos)) AS body
  FROM w JOIN s USING (entry_index, hunk) GROUP BY entry_index, hunk, part, b0, r0""")
def hunk_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Hunks split where three or more unchanged lines stand between changes."""
    rows = hunks.parts(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch", 2)
    return rows.withColumn("body", F.md5(F.array_join("body", "\n")))


@query(rf"""WITH {_PARTS} SELECT entry_index, b0 AS base_start, sum((line[1] <> '+')::INT)::BIGINT AS base_len, r0 AS remote_start, sum((line[1] <> '-')::INT)::BIGINT AS remote_len, md5(string_agg(line, chr(10) ORDER BY pos)) AS body, true AS ok FROM x JOIN s USING (entry_index, hunk) GROUP BY entry_index, hunk, b0, r0""")
def hunk_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """The parts put together again: the hunks as they were."""
    pieces = hunks.parts(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch", 2)
    return hunks.coalesced(pieces, "entry_index").withColumn("body", F.md5(F.array_join("body", "\n")))


@query(rf"""WITH {_PARTS}, d AS (SELECT DISTINCT entry_index, hunk, part > 1 AS late, pos, line, bb, rb FROM w)
  SELECT entry_index, late, (b0 + min(bb))::BIGINT AS base_start, sum((line[1] <> '+')::INT)::BIGINT AS base_len, (r0 + min(rb))::BIGINT AS remote_start, sum((line[1] <> '-')::INT)::BIGINT AS remote_len, md5(string_agg(line, chr(10) ORDER BY pos)) AS body, NOT late AS ok FROM d JOIN s USING (entry_index, hunk) GROUP BY entry_index, hunk, late, b0, r0""")
def hunk_coalesce_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The parts put together again, but the first of a hunk apart from the later ones, which have another flag."""
    pieces = hunks.parts(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch", 2)
    return hunks.coalesced(pieces.withColumn("late", F.col("part") > 1), "entry_index", "late").withColumn("body", F.md5(F.array_join("body", "\n")))


@query(rf"""WITH {_PARTS}, q AS (SELECT entry_index, b0, sum((line[1] <> '+')::INT)::BIGINT AS bl, r0, sum((line[1] <> '-')::INT)::BIGINT AS rl, string_agg(line, chr(10) ORDER BY pos) AS body FROM x JOIN s USING (entry_index, hunk) GROUP BY entry_index, hunk, b0, r0)
  SELECT entry_index, md5('@@ -' || b0 || CASE WHEN bl = 1 THEN '' ELSE ',' || bl END || ' +' || r0 || CASE WHEN rl = 1 THEN '' ELSE ',' || rl END || ' @@' || chr(10) || body || chr(10)) AS rendered FROM q""")
def hunk_render(spark: SparkSession, folder: str) -> DataFrame:
    """Every hunk written anew from its lines."""
    rows = hunks.parts(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch", 1_000_000)
    return rows.select("entry_index", F.md5(hunks.rendered(*(F.col(c) for c in ("base_start", "base_len", "remote_start", "remote_len", "body")))).alias("rendered"))


@query(r"""WITH s AS (SELECT entry_index, code AS a, patched_code AS b, regexp_replace(code, '[\t-\r \x{85}\pZ]+', '', 'g') AS sa, regexp_replace(patched_code, '[\t-\r \x{85}\pZ]+', '', 'g') AS sb FROM test_entries WHERE code IS NOT NULL AND patched_code IS NOT NULL)
  SELECT entry_index, CASE WHEN a = b THEN 'identical' WHEN sa = sb THEN 'white_space' WHEN starts_with(b, a) OR ends_with(b, a) THEN 'extended' WHEN starts_with(a, b) OR ends_with(a, b) THEN 'cut' WHEN lower(sa) = lower(sb) THEN 'letter_case' ELSE 'changed' END AS rule FROM s""")
def resolution_rule(spark: SparkSession, folder: str) -> DataFrame:
    """The first rule of a cascade that tells how two sides differ."""
    a, b = F.col("code"), F.col("patched_code")
    sa, sb = tx.without_space(a), tx.without_space(b)
    rule = (
        F.when(a == b, "identical").when(sa == sb, "white_space").when(b.startswith(a) | b.endswith(a), "extended").when(a.startswith(b) | a.endswith(b), "cut").when(F.lower(sa) == F.lower(sb), "letter_case").otherwise("changed")
    )
    return table(spark, folder, "test_entries").where("code is not null and patched_code is not null").select("entry_index", rule.alias("rule"))


@query(r"""WITH w AS (SELECT entry_index, list_distinct(regexp_extract_all(code, '[A-Za-z0-9_]+')) AS a, list_distinct(regexp_extract_all(patched_code, '[A-Za-z0-9_]+')) AS b FROM test_entries WHERE code IS NOT NULL AND patched_code IS NOT NULL)
  SELECT entry_index, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS gone, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS new, len(list_filter(a, lambda x: list_contains(b, x))) AS kept FROM w""")
def word_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct words that are gone, new and kept between two sides."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    rows = table(spark, folder, "test_entries").where("code is not null and patched_code is not null").select("entry_index", words("code").alias("a"), words("patched_code").alias("b"))
    return rows.select("entry_index", F.size(F.array_except("a", "b")).alias("gone"), F.size(F.array_except("b", "a")).alias("new"), F.size(F.array_intersect("a", "b")).alias("kept"))


@query()
def word_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Words that are gone, new and kept between two sides, in order."""
    return diffs.word_counts(table(spark, folder, "test_entries"), "entry_index", "code", "patched_code")


@query(r"""SELECT request_id, replace(replace(rtrim(base64(unhex(sha256(coalesce(patch, '')))), '='), '+', '-'), '/', '_') AS short FROM api_requests""")
def url_key(spark: SparkSession, folder: str) -> DataFrame:
    """A content key in URL-safe base64 without padding."""
    raw = F.base64(F.unhex(F.sha2(F.coalesce("patch", F.lit("")), 256)))
    return table(spark, folder, "api_requests").select("request_id", F.rtrim(F.translate(raw, "+/", "-_"), F.lit("=")).alias("short"))


@query("""SELECT request_id, unnest(range(0, 5)) AS attempt, unnest(list_transform(range(0, 5), lambda k: least(delay * pow(2, k), max_delay)::BIGINT)) AS wait FROM api_requests JOIN endpoints USING (endpoint_index)""")
def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The waits of five attempts of each request: doubled each time, up to the endpoint's longest."""
    rows = table(spark, folder, "api_requests").select("request_id", "endpoint_index").join(table(spark, folder, "endpoints").select("endpoint_index", "delay", "max_delay"), "endpoint_index")
    return rows.select("request_id", "delay", "max_delay", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("attempt")).select("request_id", "attempt", F.least(F.col("delay") * F.pow(F.lit(2), F.col("attempt")), F.col("max_delay")).cast("long").alias("wait"))


@query(rf"""WITH {_PARTS}, m AS (SELECT entry_index, hunk, min(pos) FILTER (WHERE changed) AS f, max(pos) FILTER (WHERE changed) AS l FROM x GROUP BY entry_index, hunk),
  c AS (SELECT x.entry_index, x.hunk, count_if(f IS NULL OR pos < f) AS before, count_if(pos > l) AS behind, sum((line[1] <> '+')::INT) AS bl, sum((line[1] <> '-')::INT) AS rl FROM x JOIN m USING (entry_index, hunk) GROUP BY x.entry_index, x.hunk)
  SELECT entry_index, hunk, 1 AS part, b0 + before AS base_first, (bl - before - behind)::BIGINT AS base_count, r0 + before AS remote_first, (rl - before - behind)::BIGINT AS remote_count FROM c JOIN s USING (entry_index, hunk)""")
def hunk_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changed ranges of every hunk on both sides."""
    pieces = hunks.parts(table(spark, folder, "test_entries").where("patch is not null"), "entry_index", "patch", 1_000_000)
    return hunks.changes(pieces, "entry_index")


@query("SELECT entry_index, substr(sha256(sha256(coalesce(code, '') || '|' || coalesce(filename, ''))), 1, 32) AS stable FROM test_entries")
def stable_id(spark: SparkSession, folder: str) -> DataFrame:
    """A short identifier from a hash of a hash."""
    text = F.concat(F.coalesce("code", F.lit("")), F.lit("|"), F.coalesce("filename", F.lit("")))
    return table(spark, folder, "test_entries").select("entry_index", F.substring(F.sha2(F.sha2(text, 256), 256), 1, 32).alias("stable"))

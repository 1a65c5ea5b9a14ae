"""Queries on the checks of answers, and on messages and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import nested
from millrace.functions.text import lines_of
from millrace.operators import acceptance, regions
from millrace.plans.registry import query
from millrace.sources.tables import table

CONTEXT = 3

_OPEN = r"(?m)^(?:```)?[{<|]{1,3}patched_code[|>}]{1,3}$\n"
_CLOSE = r"^[{<|/]{1,4}patched_code[|>}]{1,3}(?:```|[<|]{1,2}eot[|>]{1,2})?$"


def _tries(n: str) -> str:
    return f"range(0, greatest({n} - 1, 1))"


_JUDGED = rf"""w AS (SELECT response_id, request_id, beam_index, patch, regexp_extract_all(coalesce(code, ''), '[^\n]*\n|[^\n]+') AS ls, coalesce(regexp_extract_all(response, '(?s){_OPEN}(.*?){_CLOSE}', 1), []) AS bs FROM api_responses JOIN api_requests USING (request_id)),
  h AS (SELECT *, ls[1:least({CONTEXT}, len(ls))] AS hs, ls[greatest(len(ls) - {CONTEXT}, least({CONTEXT}, len(ls))) + 1:len(ls)] AS ts FROM w),
  c AS (SELECT response_id, request_id, beam_index, patch, array_to_string(hs, '') AS head, array_to_string(ts, '') AS tail, len(hs) AS nh, len(ts) AS nt, array_to_string(ls[len(hs) + 1:len(ls) - len(ts)], '') AS own,
    unnest(CASE WHEN len(bs) = 0 THEN [NULL] ELSE bs END) AS txt, unnest(CASE WHEN len(bs) = 0 THEN [NULL] ELSE range(0, len(bs)) END)::INT AS block FROM h),
  b AS (SELECT *, list_filter(list_transform({_tries('nh')}, lambda k: repeat(chr(10), k) || txt), lambda x: starts_with(x, head))[1] AS begun FROM c),
  e AS (SELECT *, list_filter(list_transform({_tries('nt')}, lambda k: begun || repeat(chr(10), k)), lambda x: ends_with(x, CASE WHEN head <> '' THEN chr(10) ELSE '' END || tail))[1] AS ended FROM b),
  r AS (SELECT *, length(ended) - length(head) - length(tail) AS n, CASE WHEN length(ended) - length(head) - length(tail) >= 0 THEN substr(ended, length(head) + 1, length(ended) - length(head) - length(tail)) END AS resolved FROM e),
  x AS (SELECT *, CASE WHEN txt IS NULL THEN 'no_block' WHEN begun IS NULL THEN 'head_context' WHEN ended IS NULL THEN 'tail_context' WHEN n < 0 THEN 'too_short' WHEN resolved <> '' AND NOT ends_with(resolved, chr(10)) THEN 'not_ended'
    WHEN regexp_matches(resolved, '(?m)^[+\-]') AND NOT regexp_matches(own, '(?m)^[+\-]') AND NOT coalesce(regexp_matches(patch, '(?m)^[^\n][+\-]'), false) THEN 'like_patch' WHEN resolved = own THEN 'no_change' END AS reason0 FROM r),
  j AS (SELECT response_id, request_id, beam_index, block, resolved, CASE WHEN reason0 IS NULL AND row_number() OVER (PARTITION BY response_id, resolved, reason0 IS NULL ORDER BY block) > 1 THEN 'repeated' ELSE reason0 END AS reason FROM x)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "api_requests").select("request_id", "patch", "code")
    rows = table(spark, folder, "api_responses").select("response_id", "request_id", "response").join(asked, "request_id")
    return acceptance.judged_blocks(rows, "response_id", "response", "patch", "code", CONTEXT)


@query(f"WITH {_JUDGED} SELECT response_id, block, reason, md5(resolved) AS resolved FROM j")
def answer_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of every answer with the first reason to turn them down."""
    return _judged(spark, folder).withColumn("resolved", F.md5("resolved"))


@query(f"""WITH {_JUDGED}, f AS (SELECT q.conflict_id, reason, coalesce(is_primary, false) AS p, reason IS NOT NULL AND reason <> 'repeated' AND coalesce(beam_index = 0, false) AND coalesce(block, 0) = 0 AS mend
    FROM j JOIN api_requests q USING (request_id) LEFT JOIN endpoints USING (endpoint_index)),
  g AS (SELECT conflict_id, count_if(reason IS NULL) AS accepted, bool_or(reason IS NULL AND p) AS gp, bool_or(mend AND p) AS mp, bool_or(mend AND NOT p) AS mo FROM f GROUP BY conflict_id)
  SELECT conflict_id, accepted, (NOT gp AND mp) OR (accepted = 0 AND mo) AS retry FROM g""")
def retry_needed(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts whose requests are to be made again."""
    told = _judged(spark, folder).select("response_id", "block", "reason")
    e = table(spark, folder, "endpoints").select("endpoint_index", "is_primary")
    who = table(spark, folder, "api_requests").select("request_id", "conflict_id", "endpoint_index").join(e, "endpoint_index", "left")
    beams = table(spark, folder, "api_responses").select("response_id", "request_id", F.coalesce("beam_index", F.lit(-1)).alias("beam_index"))
    return acceptance.retries(told.join(beams, "response_id").join(who, "request_id"), "conflict_id", "is_primary", "beam_index")


@query(f"WITH {_JUDGED} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS blocks FROM j GROUP BY 1")
def check_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("blocks"))


_TRAILER = r"""(contains(x, ':') AND (ends_with(lower(trim(split_part(x, ':', 1))), '-by') OR contains(lower(split_part(x, ':', 1)), 'fixes') OR contains(lower(split_part(x, ':', 1)), 'link')
  OR regexp_matches(lower(substr(x, instr(x, ':') + 1)), 'https?://|@')))"""


@query(rf"""WITH p AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '\r', '', 'g'), '\n[ \t]*\n'), lambda x: regexp_matches(x, '[^ \t\n]')) AS ps FROM documents WHERE text IS NOT NULL),
  q AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM p),
  l AS (SELECT *, list_transform(list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '[^ \t]')), lambda x: {_TRAILER}) AS marks FROM q),
  k AS (SELECT * FROM l WHERE NOT CASE WHEN i = n THEN list_bool_or(marks) ELSE list_bool_and(marks) END)
  SELECT doc_id, count(*) AS paragraphs, md5(string_agg(p, chr(10) || chr(10) ORDER BY i)) AS body FROM k GROUP BY doc_id""")
def message_body(spark: SparkSession, folder: str) -> DataFrame:
    """Messages without trailer paragraphs: the last paragraph goes if any of its lines is a trailer, others if all are.

    Messages of which nothing is left have no row.
    """
    def trailer(x):
        key, value = F.lower(F.split_part(x, F.lit(":"), F.lit(1))), F.lower(F.substr(x, F.instr(x, ":") + 1))
        return x.contains(":") & (F.trim(key).endswith("-by") | key.contains("fixes") | key.contains("link") | value.rlike("https?://|@"))

    parts = F.filter(F.split(F.replace("text", F.lit("\r")), r"\n[ \t]*\n", -1), lambda x: x.rlike(r"[^ \t\n]"))
    marks = lambda p: F.transform(F.filter(F.split(p, "\n", -1), lambda x: x.rlike(r"[^ \t]")), trailer)
    goes = lambda p, last: F.when(last, F.exists(marks(p), lambda m: m)).otherwise(F.forall(marks(p), lambda m: m))
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", parts.alias("ps"))
    kept = rows.select("doc_id", F.filter("ps", lambda p, i: ~goes(p, i == F.size("ps") - 1)).alias("kept")).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("paragraphs"), F.md5(F.array_join("kept", "\n\n")).alias("body"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '#')), chr(10))) AS plain FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?m)^#')")
def without_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that hold comment lines, without them."""
    plain = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~x.startswith("#")), "\n")
    return table(spark, folder, "documents").where(F.col("text").rlike(r"(?m)^#")).select("doc_id", F.md5(plain).alias("plain"))


BUDGET, MOST_LINES = 1500, 12


@query(f"""WITH r AS (SELECT request_id, conflict_id, strlen(coalesce(git_diff, '')) AS bytes, len(regexp_extract_all(coalesce(patch, ''), chr(10))) AS lines FROM api_requests),
  s AS (SELECT *, sum(strlen(git_diff)) OVER (PARTITION BY conflict_id)::BIGINT AS whole FROM r JOIN (SELECT request_id AS i, coalesce(git_diff, '') AS git_diff FROM api_requests) ON i = request_id)
  SELECT request_id, bytes <= {BUDGET} AS diff_fits, lines <= {MOST_LINES} AS hunk_fits, CASE WHEN whole <= {BUDGET} THEN bytes ELSE 0 END AS kept_bytes FROM s""")
def size_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Size gates: a diff by its bytes, a hunk by its lines, and all snippets of a conflict together or none of them."""
    rows = table(spark, folder, "api_requests").select("request_id", "conflict_id", F.coalesce(F.octet_length("git_diff"), F.lit(0)).cast("long").alias("bytes"), F.regexp_count(F.coalesce("patch", F.lit("")), F.lit("\n")).alias("lines"))
    whole = rows.groupBy("conflict_id").agg(F.sum("bytes").alias("whole"))
    met = rows.alias("a").join(whole.alias("b"), F.col("a.conflict_id").eqNullSafe(F.col("b.conflict_id")))
    return met.select("request_id", (F.col("bytes") <= BUDGET).alias("diff_fits"), (F.col("lines") <= MOST_LINES).alias("hunk_fits"), F.when(F.col("whole") <= BUDGET, F.col("bytes")).otherwise(0).alias("kept_bytes"))


_TOKENS = r"""t AS (SELECT response_id, regexp_extract_all(response, '[ \n\t\r]*[^ \n\t\r]{1,4}|[ \n\t\r]+') AS ts, instr(response, '<|patched_code|>' || chr(10)) AS a, response FROM api_responses WHERE response IS NOT NULL),
  s AS (SELECT *, a - 1 + 17 AS first, instr(substr(response, a + 17), '<|/patched_code|>') AS z FROM t WHERE a > 0),
  k AS (SELECT response_id, first, first + z - 1 AS last, ts, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS i FROM s WHERE z > 0),
  o AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY response_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
    -(('0x' || substr(md5(response_id || ':' || i || ':' || token), 1, 6))::BIGINT % 9973) / 1000.0::DOUBLE AS p, -(('0x' || substr(md5(response_id || ':' || i || ':' || token), 7, 6))::BIGINT % 9973) / 1000.0::DOUBLE AS q FROM k)"""


def _scored_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with a whole tagged block, cut into pieces of at most four visible characters, each with two scores below zero
    that stand for those of its first and second choice, made from a digest of the piece."""
    tokens = F.regexp_extract_all("response", F.lit(r"[ \n\t\r]*[^ \n\t\r]{1,4}|[ \n\t\r]+"), F.lit(0))
    at = F.instr("response", "<|patched_code|>\n")
    rows = table(spark, folder, "api_responses").select("response_id", "response", at.alias("a"), tokens.alias("ts")).where("a > 0")
    rows = rows.select("response_id", "ts", (F.col("a") + 16).alias("first"), F.instr(F.substr("response", F.col("a") + 17), "<|/patched_code|>").alias("z")).where("z > 0")
    score = lambda d, k: -(F.conv(F.substring(d, k, 6), 16, 10).cast("long") % 9973) / F.lit(1000.0)
    digest = lambda x, i: F.md5(F.concat_ws(":", F.col("response_id").cast("string"), i.cast("string"), x))
    cells = F.transform(F.arrays_zip(F.transform("ts", lambda x: F.length(x)), F.transform("ts", digest), "ts"), lambda x: F.struct(x["0"].alias("n"), score(x["1"], 1).alias("p"), score(x["1"], 7).alias("q"), x["ts"].alias("token")))
    exploded = rows.select("response_id", "first", (F.col("first") + F.col("z") - 1).alias("last"), F.posexplode(cells).alias("i", "x")).select("response_id", "first", "last", "i", "x.*")
    w = Window.partitionBy("response_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return exploded.withColumn("off", F.coalesce(F.sum("n").over(w), F.lit(0)))


_INSIDE = "off >= first AND off < last"


@query(f"""WITH {_TOKENS} SELECT response_id, min_by(i, (p, i)) AS lowest, min_by(i, (p, i)) FILTER (WHERE {_INSIDE}) AS lowest_inside, min(p) FILTER (WHERE {_INSIDE}) AS score, count(*) AS tokens FROM o GROUP BY response_id""")
def token_argmin(spark: SparkSession, folder: str) -> DataFrame:
    """The least likely piece of each answer, and that inside its block; the first of equals."""
    o = _scored_tokens(spark, folder)
    inside = F.expr(_INSIDE)
    least = lambda c: F.min(c)["i"]
    pair = F.struct("p", "i")
    return o.groupBy("response_id").agg(least(pair).alias("lowest"), least(F.when(inside, pair)).alias("lowest_inside"), F.min(F.when(inside, F.col("p"))).alias("score"), F.count("*").alias("tokens"))


@query(rf"""WITH {_TOKENS}, g AS (SELECT *, abs(p - q) * -greatest(p, q) AS gain FROM o WHERE {_INSIDE} AND NOT regexp_matches(token, '[ \n\t\r]$') AND token <> ''),
  r AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY gain DESC, i) AS rank FROM g)
  SELECT response_id, rank, i AS position, md5(array_to_string(ts[1:i], '') || '~' || token) AS prefix FROM r WHERE rank <= 2""")
def continuations(spark: SparkSession, folder: str) -> DataFrame:
    """The two pieces of each block with the greatest gap between their choices times the better choice's score, and the text
    before each with the other choice (here the piece with a sign before it) behind it; pieces that end in white space are passed over."""
    o = _scored_tokens(spark, folder)
    gain = F.abs(F.col("p") - F.col("q")) * -F.greatest("p", "q")
    g = o.where(F.expr(_INSIDE) & ~F.col("token").rlike(r"[ \n\t\r]\z") & (F.col("token") != "")).withColumn("gain", gain)
    w = Window.partitionBy("response_id").orderBy(F.desc("gain"), "i")
    best = g.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("response_id", "rank", "i", "off", F.concat(F.lit("~"), F.col("token")).alias("other"))
    texts = table(spark, folder, "api_responses").select("response_id", "response")
    return best.join(texts, "response_id").select("response_id", "rank", F.col("i").alias("position"), F.md5(F.concat(F.substr("response", F.lit(1), F.col("off").cast("int")), F.col("other"))).alias("prefix"))


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_no, strlen(text) // 2 AS half FROM documents),
  b AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS stop FROM l) SELECT doc_id, half AS byte_at, line_no, (stop - strlen(line))::BIGINT AS line_start FROM b WHERE half >= stop - strlen(line) AND half < stop""")
def byte_line(spark: SparkSession, folder: str) -> DataFrame:
    """The line that holds the middle byte of each document, and the byte at which that line starts."""
    lines = table(spark, folder, "documents").select("doc_id", F.floor(F.octet_length("text") / 2).alias("byte_at"), F.transform(lines_of(F.col("text")), lambda x: F.octet_length(x)).alias("sizes"))
    found = lines.select("doc_id", "byte_at", F.posexplode("sizes").alias("line_no", "size"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    ended = found.withColumn("stop", F.sum("size").over(w))
    return ended.where((F.col("byte_at") >= F.col("stop") - F.col("size")) & (F.col("byte_at") < F.col("stop"))).select("doc_id", "byte_at", "line_no", (F.col("stop") - F.col("size")).alias("line_start"))


_MARKED = r"""c AS (SELECT request_id, regexp_extract_all(code, '[^\n]*\n|[^\n]+') AS ls, coalesce(patch, '') AS p FROM api_requests WHERE code IS NOT NULL),
  m AS (SELECT request_id, array_to_string(ls[1:2], '') || '<<<<<<< local' || chr(10) || array_to_string(ls[3:4], '') || CASE WHEN request_id % 7 = 0 THEN '<<<<<<< inner' || chr(10) ELSE '' END
    || CASE WHEN request_id % 2 = 0 THEN '||||||| base' || chr(10) || array_to_string(ls[3:3], '') ELSE '' END || CASE WHEN request_id % 13 = 0 THEN '' ELSE '=======' || chr(10) END || array_to_string(ls[4:5], '')
    || CASE WHEN request_id % 3 = 0 THEN '&&&&&&& one' || chr(10) || array_to_string(ls[5:5], '') || '&&&&&&& two' || chr(10) ELSE '' END || '>>>>>>> remote' || chr(10) || array_to_string(ls[5:6], '')
    || '<<<<<<< local' || chr(10) || array_to_string(ls[7:8], '') || '||||||| base' || chr(10) || '=======' || chr(10) || array_to_string(ls[8:9], '') || CASE WHEN request_id % 11 = 0 THEN '' ELSE '>>>>>>> remote' || chr(10) END || array_to_string(ls[9:len(ls)], '') AS text FROM c)"""


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every request with two marked regions: with and without a base and answers, some nested, open or broken."""
    ls = lines_of(F.col("code"))
    part = lambda a, b: F.array_join(F.slice("ls", a, b - a + 1), "")
    when = lambda n, text, other="": F.when(F.col("request_id") % n == 0, text).otherwise(other)
    rest = F.array_join(F.slice("ls", F.lit(9), F.greatest(F.size("ls") - 8, F.lit(0))), "")
    text = F.concat(
        part(1, 2), F.lit("<<<<<<< local\n"), part(3, 4), when(7, F.lit("<<<<<<< inner\n")), when(2, F.concat(F.lit("||||||| base\n"), part(3, 3))), when(13, F.lit(""), F.lit("=======\n")), part(4, 5),
        when(3, F.concat(F.lit("&&&&&&& one\n"), part(5, 5), F.lit("&&&&&&& two\n"))), F.lit(">>>>>>> remote\n"), part(5, 6),
        F.lit("<<<<<<< local\n"), part(7, 8), F.lit("||||||| base\n=======\n"), part(8, 9), when(11, F.lit(""), F.lit(">>>>>>> remote\n")), rest,
    )
    return table(spark, folder, "api_requests").where("code is not null").select("request_id", ls.alias("ls")).select("request_id", text.alias("text"))


_LINE_KIND = "CASE WHEN starts_with(line, '<<<<<<< ') THEN '<' WHEN starts_with(line, '||||||| ') THEN '|' WHEN rtrim(line, chr(10)) = '=======' THEN '=' WHEN starts_with(line, '&&&&&&& ') THEN '&' WHEN starts_with(line, '>>>>>>>') THEN '>' END"


def _between(lo: str, hi: str) -> str:
    return f"array_to_string(list_transform(list_filter(x, lambda v: v.pos > {lo} AND v.pos < {hi}), lambda v: v.line), '')"


@query(rf"""WITH {_MARKED}, l AS (SELECT request_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS pos FROM m),
  k AS (SELECT *, {_LINE_KIND} AS kind FROM l), r AS (SELECT *, sum(coalesce((kind = '<')::INT, 0)) OVER (PARTITION BY request_id ORDER BY pos)::BIGINT AS region FROM k),
  o AS (SELECT request_id, region, min(pos) FILTER (WHERE kind = '<') AS l, min(pos) FILTER (WHERE kind = '|') AS b, min(pos) FILTER (WHERE kind = '=') AS q, min(pos) FILTER (WHERE kind = '&') AS a, min(pos) FILTER (WHERE kind = '>') AS e,
    count_if(kind = '&') AS answers, list(struct_pack(pos := pos, line := line, kind := kind) ORDER BY pos) AS x FROM r GROUP BY request_id, region),
  f AS (SELECT *, list_transform(list_filter(x, lambda v: l IS NULL OR coalesce(v.pos > e, false)), lambda v: v.line) AS after, list_min(list_transform(list_filter(x, lambda v: v.kind = '&' AND v.pos > a), lambda v: v.pos)) AS a2 FROM o),
  t AS (SELECT *, CASE WHEN e IS NULL THEN CASE WHEN lead(region) OVER w IS NOT NULL THEN 'nested' ELSE 'open' END WHEN q IS NULL THEN 'no_lower' WHEN NOT (l < coalesce(b, q) AND coalesce(b, q - 1) < q AND q < coalesce(a, e) AND coalesce(a, e) <= e) THEN 'unordered' END AS error,
    lag(after) OVER w AS past FROM f WINDOW w AS (PARTITION BY request_id ORDER BY region)),
  u AS (SELECT *, coalesce(sum(CASE WHEN error IS NULL AND l IS NOT NULL THEN e - l + 1 - (coalesce(b, q) - l - 1) ELSE 0 END) OVER (PARTITION BY request_id ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS extra FROM t)
  SELECT request_id, region, error, CASE WHEN error IS NULL THEN md5({_between('l', 'coalesce(b, q)')}) END AS upper, CASE WHEN error IS NULL AND b IS NOT NULL THEN md5({_between('b', 'q')}) END AS base, CASE WHEN error IS NULL THEN md5({_between('q', 'coalesce(a, e)')}) END AS lower,
    CASE WHEN error IS NULL THEN answers END AS answers, CASE WHEN error IS NULL AND a IS NOT NULL THEN md5({_between('a', 'coalesce(a2, e)')}) END AS answer,
    CASE WHEN error IS NULL THEN md5(array_to_string(past[greatest(len(past) - 3, 0) + 1:], '')) END AS head, CASE WHEN error IS NULL THEN md5(array_to_string(after[1:3], '')) END AS tail, CASE WHEN error IS NULL THEN (l - extra)::BIGINT END AS upper_start FROM u WHERE region > 0""")
def region_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Several regions a text with their sides, answers, context cut at the neighbours, and what is wrong with them."""
    found = regions.parsed(_marked(spark, folder), "request_id", "text", 3)
    return found.select("request_id", "region", "error", *(F.md5(c).alias(c) for c in ("upper", "base", "lower")), "answers", *(F.md5(c).alias(c) for c in ("answer", "head", "tail")), F.col("upper_start").cast("long").alias("upper_start"))


@query(r"""WITH c AS (SELECT request_id, regexp_extract_all(code, '[^\n]*\n|[^\n]+') AS ls FROM api_requests WHERE code IS NOT NULL)
  SELECT request_id, md5(CASE WHEN request_id % 5 = 0 OR len(ls) < 6 THEN array_to_string(ls, '') ELSE 'new head' || chr(10) || array_to_string(ls[1:1], '') || 'swap' || chr(10) || array_to_string(ls[4:5], '') || array_to_string(ls[7:], '') END) AS text FROM c""")
def many_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Three edits of each file at once: a line before the first, two lines replaced by one, and a line cut out."""
    files = table(spark, folder, "api_requests").where("code is not null").select("request_id", F.col("code").alias("text"))
    chosen = files.where((F.col("request_id") % 5 != 0) & (F.size(lines_of(F.col("text"))) >= 6)).select("request_id")
    edit = lambda a, b, new: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("replacement"))
    edits = chosen.select("request_id", F.inline(F.array(edit(5, 6, ""), edit(0, 0, "new head\n"), edit(1, 3, "swap\n"))))
    return regions.spliced(files, edits, "request_id", "text").withColumn("text", F.md5("text"))


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every response in the payload of one of three kinds: a chat, a plain completion, or an error."""
    r = table(spark, folder, "api_responses").select("response_id", "response", "output_tokens")
    k = F.col("response_id") % 5
    sign = F.struct(F.lit("s").alias("thoughtSignature"), F.struct(F.lit(1).alias("signature_count"), "response_id").alias("inner")).alias("meta")
    usage = F.struct(F.col("output_tokens").alias("completion_tokens")).alias("usage")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("response").alias("content"), F.lit("x").alias("signature")).alias("message"), sign)).alias("choices"), usage))
    plain = F.to_json(F.struct(F.array(F.struct(F.col("response").alias("text"))).alias("choices"), usage))
    broken = F.to_json(F.struct(F.struct(F.lit("quota").alias("code"), F.array(F.struct(F.lit("a").alias("name"), F.col("response_id").cast("string").alias("value"))).alias("params")).alias("error")))
    return r.select("response_id", F.when(k == 4, broken).when(k % 2 == 0, chat).otherwise(plain).alias("payload"))


@query("SELECT response_id, CASE WHEN response_id % 5 <> 4 THEN md5(response) END AS content, CASE WHEN response_id % 5 <> 4 THEN output_tokens END AS tokens, CASE WHEN response_id % 5 = 4 THEN 'quota' END AS code FROM api_responses")
def payload_content(spark: SparkSession, folder: str) -> DataFrame:
    """What a payload says: the chat's content, else the completion's text, and the code of an error."""
    at = lambda path: F.get_json_object("payload", path)
    content = F.coalesce(at("$.choices[0].message.content"), at("$.choices[0].text"))
    return _payloads(spark, folder).select("response_id", F.md5(content).alias("content"), at("$.usage.completion_tokens").cast("long").alias("tokens"), at("$.error.code").alias("code"))


@query("""SELECT response_id, CASE WHEN response_id % 5 <> 4 THEN md5(response) END AS content, 0 AS signs, CASE WHEN response_id % 5 IN (0, 2) THEN response_id END AS inner_id FROM api_responses""")
def payload_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads with all signatures blanked at every depth: what is left of them, and how many signatures are."""
    found = nested.redacted(_payloads(spark, folder), "response_id", "payload", "signature")
    at = lambda path: F.get_json_object("payload", path)
    signs = sum((at(p).isNotNull().cast("int") for p in ("$.choices[0].message.signature", "$.choices[0].meta.thoughtSignature")), at("$.choices[0].meta.inner.signature_count").isNotNull().cast("int"))
    content = F.coalesce(at("$.choices[0].message.content"), at("$.choices[0].text"))
    return found.select("response_id", F.md5(content).alias("content"), signs.alias("signs"), at("$.choices[0].meta.inner.response_id").cast("long").alias("inner_id"))


@query("SELECT response_id, CASE WHEN response_id % 5 = 4 THEN response_id END AS value FROM api_responses")
def payload_object(spark: SparkSession, folder: str) -> DataFrame:
    """The first object of a payload, depth first, that has a name and a value."""
    found = nested.first_object(_payloads(spark, folder), "response_id", "payload", ["name", "value"])
    return found.select("response_id", F.get_json_object("payload", "$.value").cast("long").alias("value"))


@query("""WITH x AS (SELECT request_id, 'system' AS role, prompt AS content FROM api_requests WHERE prompt <> '' UNION ALL
    SELECT request_id, 'user', concat_ws(chr(10) || chr(10), nullif(patch, ''), nullif(code, ''), CASE WHEN endpoint_type IS DISTINCT FROM 'tuned' THEN nullif(git_diff, '') END) FROM api_requests LEFT JOIN endpoints USING (endpoint_index))
  SELECT request_id, role, md5(content) AS content FROM x WHERE content <> ''""")
def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of each request by role: its elements in order with a blank line between, empty ones left out, the diff
    suppressed for tuned endpoints, and no message without an element."""
    e = table(spark, folder, "endpoints").select("endpoint_index", "endpoint_type")
    rows = table(spark, folder, "api_requests").join(e, "endpoint_index", "left")
    diff = F.when(~F.col("endpoint_type").eqNullSafe(F.lit("tuned")), F.col("git_diff"))
    layout = F.array(F.struct(F.lit("system").alias("role"), F.array("prompt").alias("parts")), F.struct(F.lit("user").alias("role"), F.array("patch", "code", diff).alias("parts")))
    joined = F.transform(layout, lambda m: F.struct(m["role"].alias("role"), F.array_join(F.filter(m["parts"], lambda p: p != ""), "\n\n").alias("content")))
    return rows.select("request_id", F.inline(F.filter(joined, lambda m: m["content"] != ""))).withColumn("content", F.md5("content"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?m)^([A-Za-z-]+): [0-9.]+% \([0-9]+/[0-9]+\)', 1) AS names FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, unnest(list_distinct(names)) AS measure, names FROM m)
  SELECT doc_id, measure, len(list_filter(names, lambda x: x = measure)) = 1 AS single FROM n""")
def report_singles(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each measure of a report stands there exactly once; a report that repeats one cannot be scraped for it."""
    names = F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z-]+): [0-9.]+% \([0-9]+/[0-9]+\)"), F.lit(1))
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", names.alias("names"))
    return rows.select("doc_id", "names", F.explode(F.array_distinct("names")).alias("measure")).select("doc_id", "measure", (F.size(F.filter("names", lambda x: x == F.col("measure"))) == 1).alias("single"))

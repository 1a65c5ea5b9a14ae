"""Queries on ranges of lines, fuzzy locations and positions in arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import fuzzy, intervals
from millrace.plans.registry import query
from millrace.sources.tables import table


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "answers").select("answer_id", "file_path", "local_start", "local_end", "commit_type")


@query("SELECT answer_id, local_start - coalesce(sum(local_end - local_start) OVER (PARTITION BY file_path ORDER BY local_start NULLS FIRST, answer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shifted FROM answers")
def running_offset(spark: SparkSession, folder: str) -> DataFrame:
    """Each start less the lengths of all ranges before it in its file."""
    rows = intervals.running_sum(_answers(spark, folder), "file_path", "local_start", "answer_id", F.col("local_end") - F.col("local_start"), "before")
    return rows.select("answer_id", (F.col("local_start") - F.col("before")).alias("shifted"))


@query("""WITH o AS (SELECT *, max(local_end) OVER (PARTITION BY file_path ORDER BY local_start, local_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM answers),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR local_start > reach + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY local_start, local_end ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o)
  SELECT file_path, island, min(local_start) AS local_start, max(local_end) AS local_end, count(*) AS members FROM i GROUP BY file_path, island""")
def interval_merge(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.islands(_answers(spark, folder), "file_path", "local_start", "local_end", gap=10)


@query("""SELECT a.answer_id, count(b.answer_id) AS overlaps FROM answers a LEFT JOIN answers b ON a.file_path = b.file_path AND b.commit_type = 'Conflict' AND b.local_start < b.local_end AND a.local_start < b.local_end AND b.local_start < a.local_end
  WHERE a.commit_type = 'Clean' AND a.local_start < a.local_end GROUP BY a.answer_id""")
def overlap_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _answers(spark, folder)
    return intervals.overlap_counts(rows.where("commit_type = 'Clean'"), rows.where("commit_type = 'Conflict'"), "file_path", "answer_id", "local_start", "local_end")


_MATCH = "((a.local_start < b.local_end AND b.local_start < a.local_end) OR a.local_start = b.local_start OR a.local_end = b.local_end)"


@query(f"""SELECT a.answer_id, count(b.answer_id) AS matches FROM answers a LEFT JOIN answers b ON a.file_path = b.file_path AND b.commit_type = 'Conflict' AND {_MATCH} WHERE a.commit_type = 'Clean' GROUP BY a.answer_id""")
def match_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many conflicts of its file each clean range overlaps, or starts or ends with; pure insertions match too."""
    rows = _answers(spark, folder)
    return intervals.match_counts(rows.where("commit_type = 'Clean'"), rows.where("commit_type = 'Conflict'"), "file_path", "answer_id", "local_start", "local_end")


@query(f"""SELECT a.answer_id AS left_item, b.answer_id AS right_item FROM answers a JOIN answers b ON a.file_path = b.file_path AND {_MATCH} WHERE a.commit_type = 'Clean' AND b.commit_type = 'Conflict'""")
def match_join(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that ``match_counts`` counts."""
    rows = _answers(spark, folder)
    return intervals.match_pairs(rows.where("commit_type = 'Clean'"), rows.where("commit_type = 'Conflict'"), "file_path", "answer_id", "local_start", "local_end")


@query(f"""SELECT a.answer_id, count(b.answer_id) AS matches FROM answers a LEFT JOIN answers b ON a.file_path = b.file_path AND a.answer_id <> b.answer_id AND {_MATCH} GROUP BY a.answer_id""")
def self_matches(spark: SparkSession, folder: str) -> DataFrame:
    """How many of all other ranges of its file each range overlaps, or starts or ends with."""
    rows = _answers(spark, folder)
    found = intervals.match_counts(rows, rows, "file_path", "answer_id", "local_start", "local_end")
    return found.select("answer_id", F.greatest(F.col("matches") - 1, F.lit(0)).alias("matches"))  # a range with all bounds matches itself


_VIEWS = "v AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 60000000)::BIGINT AS s, (epoch_us(ts) // 60000000)::BIGINT + floor(value)::BIGINT AS e FROM events)"


def _views(spark: SparkSession, folder: str) -> DataFrame:
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", s.alias("s"), (s + F.floor("value")).alias("e"))


@query(f"WITH {_VIEWS} SELECT a.event_id AS left_item, b.event_id AS right_item FROM v a JOIN v b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'view' AND b.event_type = 'click' AND a.s < a.e AND b.s < b.e")
def overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    v = _views(spark, folder)
    return intervals.overlap_pairs(v.where("event_type = 'view'"), v.where("event_type = 'click'"), "user_id", "event_id", "s", "e", width=64)


@query("""WITH RECURSIVE o AS (SELECT file_path, local_start, local_end, answer_id, row_number() OVER (PARTITION BY file_path ORDER BY local_start, local_end, answer_id) AS n FROM answers),
  w AS (SELECT *, true AS kept, local_end AS reach FROM o WHERE n = 1 UNION ALL
        SELECT o.*, o.local_start >= w.reach, CASE WHEN o.local_start >= w.reach THEN o.local_end ELSE w.reach END FROM w JOIN o ON o.file_path = w.file_path AND o.n = w.n + 1)
  SELECT file_path, local_start, local_end, answer_id FROM w WHERE kept""")
def overlap_anti(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.accept_disjoint(_answers(spark, folder), "file_path", "answer_id", "local_start", "local_end")


@query("""SELECT a.answer_id, coalesce(sum(b.local_end - b.local_start), 0)::BIGINT AS total FROM answers a LEFT JOIN answers b ON a.file_path = b.file_path AND b.commit_type = 'Conflict' AND b.local_end <= a.local_start WHERE a.commit_type = 'Clean' GROUP BY a.answer_id""")
def prefix_sum_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = _answers(spark, folder)
    length = F.col("local_end") - F.col("local_start")
    return intervals.sum_before(rows.where("commit_type = 'Clean'"), rows.where("commit_type = 'Conflict'"), "file_path", "answer_id", "local_start", "local_end", length)


@query("""WITH l AS (SELECT *, lag(local_end) OVER (PARTITION BY file_path ORDER BY local_start, local_end, answer_id) AS before FROM answers)
  SELECT answer_id, unnest(list_filter([CASE WHEN local_end < local_start THEN 'reversed' END, CASE WHEN local_start < before THEN 'crosses_previous' END, CASE WHEN local_start = local_end AND before = local_start THEN 'empty_not_apart' END], lambda x: x IS NOT NULL)) AS rule FROM l""")
def range_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.violations(_answers(spark, folder), "file_path", "answer_id", "local_start", "local_end")


@query("SELECT answer_id, lag(local_end, 1, 0) OVER w AS previous_end, lead(local_start, 1, 1000000) OVER w AS next_start FROM answers WINDOW w AS (PARTITION BY file_path ORDER BY local_start, local_end, answer_id)")
def neighbour_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.gaps_around(_answers(spark, folder), "file_path", "answer_id", "local_start", "local_end", 1_000_000)


@query("SELECT file_path, min(local_start) AS hull_start, max(local_end) AS hull_end, count(*) AS ranges FROM answers GROUP BY file_path")
def range_hull(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).groupBy("file_path").agg(F.min("local_start").alias("hull_start"), F.max("local_end").alias("hull_end"), F.count("*").alias("ranges"))


_SPLIT = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace({0}, '\\n\\z', ''), chr(10)) END"
_DIST = "levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)"


@query(rf"""WITH p AS (SELECT entry_index, {_SPLIT.format('patch')} AS ls FROM test_entries WHERE patch IS NOT NULL),
  a AS (SELECT entry_index, unnest(list_transform(list_filter(ls, lambda x: x[1] = '+'), lambda x: x[2:])) AS a FROM p), r AS (SELECT entry_index, unnest(list_transform(list_filter(ls, lambda x: x[1] = '-'), lambda x: x[2:])) AS r FROM p)
  SELECT DISTINCT a.entry_index FROM a JOIN r ON a.entry_index = r.entry_index WHERE regexp_matches(a, '\S') AND regexp_matches(r, '\S') AND {_DIST.format('a', 'r')} <= 0.4""")
def fuzzy_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of which some added line is close to some removed line."""
    side = lambda s: F.transform(F.filter(tx.bare_lines(F.col("patch")), lambda x: x.startswith(s)), lambda x: F.substr(x, F.lit(2)))
    return table(spark, folder, "test_entries").where("patch is not null").where(fuzzy.any_close(side("+"), side("-"), 0.4)).select("entry_index")


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the lines of their code and the first and last context line of their patch."""
    body = F.filter(tx.bare_lines(F.col("patch")), lambda x: x.startswith(" "))
    rows = table(spark, folder, "api_requests").where("patch is not null and code is not null")
    edge = lambda i: F.substr(F.get(body, i), F.lit(2))
    return rows.select("request_id", tx.bare_lines(F.col("code")).alias("lines"), edge(F.lit(0)).alias("head"), edge(F.size(body) - 1).alias("tail")).where("head is not null and size(lines) > 0")


_LOCATED = rf"""c AS (SELECT request_id, {_SPLIT.format('code')} AS ls, list_filter({_SPLIT.format('patch')}, lambda x: x[1] = ' ') AS b FROM api_requests WHERE patch IS NOT NULL AND code IS NOT NULL),
  q AS (SELECT request_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, b[1][2:] AS head, b[-1][2:] AS tail FROM c WHERE len(b) > 0)"""


@query(rf"""WITH {_LOCATED}, d AS (SELECT request_id, i, {_DIST.format('line', 'head')} AS d FROM q) SELECT request_id, min_by(i, (d, i)) AS position, round(min(d), 6) AS distance FROM d GROUP BY request_id""")
def sliding_argmin(spark: SparkSession, folder: str) -> DataFrame:
    """The line of the code that is nearest to the first context line of the patch."""
    best = _located(spark, folder).select("request_id", fuzzy.best_window(F.col("lines"), F.col("head")).alias("b"))
    return best.select("request_id", F.col("b.position").alias("position"), F.round("b.distance", 6).alias("distance"))


@query(rf"""WITH {_LOCATED}, d AS (SELECT request_id, i, {_DIST.format('line', 'head')} AS h, {_DIST.format('line', 'tail')} AS t FROM q)
  SELECT a.request_id, min_by(a.i, (a.h + b.t, a.i, b.i)) AS head, min_by(b.i, (a.h + b.t, a.i, b.i)) AS tail, round(min(a.h + b.t), 6) AS distance FROM d a JOIN d b ON a.request_id = b.request_id AND a.i <= b.i GROUP BY a.request_id""")
def pair_argmin(spark: SparkSession, folder: str) -> DataFrame:
    """The pair of lines, in order, that is nearest to the first and the last context line together."""
    best = _located(spark, folder).select("request_id", fuzzy.best_pair(F.col("lines"), F.col("head"), F.col("tail")).alias("b"))
    return best.select("request_id", F.col("b.head").alias("head"), F.col("b.tail").alias("tail"), F.round("b.sum", 6).alias("distance"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, min_by(i, (x, i)) AS position, round(min(x)::DOUBLE, 6) AS lowest FROM e GROUP BY vec_id""")
def array_argmin(spark: SparkSession, folder: str) -> DataFrame:
    """The first position of the least element."""
    best = F.array_min(F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))
    return table(spark, folder, "embeddings").select("vec_id", best.alias("b")).select("vec_id", F.col("b.i").alias("position"), F.round(F.col("b.x").cast("double"), 6).alias("lowest"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  g AS (SELECT vec_id, i, x, abs(x - lead(x) OVER (PARTITION BY vec_id ORDER BY i)) * -x AS score FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC NULLS LAST, i) AS rank FROM g)
  SELECT vec_id, rank, i AS position FROM r WHERE rank <= 2""")
def top2_uncertain(spark: SparkSession, folder: str) -> DataFrame:
    """The two positions with the greatest gap to the next element times the negated value."""
    scored = F.transform("embedding", lambda x, i: F.struct((-(F.abs(x - F.get("embedding", i + 1)) * -x)).alias("s"), i.cast("long").alias("i")))
    ranked = F.slice(F.concat(F.sort_array(F.filter(scored, lambda v: v["s"].isNotNull())), F.filter(scored, lambda v: v["s"].isNull())), 1, 2)
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(ranked).alias("p", "v")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("v.i").alias("position"))


@query(rf"""WITH {_LOCATED}, d AS (SELECT request_id, i, {_DIST.format('line', 'head')} AS h, {_DIST.format('line', 'tail')} AS t FROM q),
  m AS (SELECT request_id, min_by(i, (h, i)) AS a, min_by(i, (t, i)) AS b, min(h) AS mh, min(t) AS mt FROM d GROUP BY request_id),
  p AS (SELECT x.request_id, min_by(x.i, (x.h + y.t, x.i, y.i)) AS a2, min_by(y.i, (x.h + y.t, x.i, y.i)) AS b2 FROM d x JOIN d y ON x.request_id = y.request_id AND x.i <= y.i GROUP BY x.request_id)
  SELECT request_id, CASE WHEN mh <= 0.75 AND mt <= 0.75 THEN CASE WHEN a <= b THEN a ELSE a2 END END AS first, CASE WHEN mh <= 0.75 AND mt <= 0.75 THEN CASE WHEN a <= b THEN b ELSE b2 END END AS last FROM m JOIN p USING (request_id)""")
def relocate_both(spark: SparkSession, folder: str) -> DataFrame:
    """Where the patch belongs in the code, by its first and last context line."""
    return fuzzy.located_range(_located(spark, folder), "request_id", "lines", "head", "tail", 0.75)


def _framed(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the lines of their code, and of their patch the leading and trailing context and both sides between."""
    rows = table(spark, folder, "api_requests").where("patch is not null and code is not null")
    rows = rows.select("request_id", tx.bare_lines(F.col("code")).alias("c"), tx.bare_lines(F.col("patch")).alias("p"))
    rows = rows.select("request_id", "c", F.slice("p", F.array_position(F.transform("p", lambda x: x.startswith("@@")), True).cast("int") + 1, F.size("p")).alias("p"))
    changed = lambda x: x.startswith("+") | x.startswith("-")
    first = F.array_position(F.transform("p", changed), True).cast("int")
    last = F.size("p") + 1 - F.array_position(F.reverse(F.transform("p", changed)), True).cast("int")
    rows = rows.where(F.exists("p", changed)).select("*", first.alias("f"), last.alias("l"))
    ended = lambda x: F.concat(x, F.lit("\n"))
    side = lambda start, length, keep: F.transform(F.filter(F.slice("p", start, length), keep), lambda x: ended(F.substr(x, F.lit(2))))
    kept, inner = lambda x: x.startswith(" "), (F.col("f"), F.col("l") - F.col("f") + 1)
    parts = {"head": side(F.lit(1), F.col("f") - 1, kept), "tail": side(F.col("l") + 1, F.size("p"), kept), "base": side(*inner, lambda x: kept(x) | x.startswith("-")), "remote": side(*inner, lambda x: kept(x) | x.startswith("+"))}
    return rows.select("request_id", F.transform("c", ended).alias("lines"), *(v.alias(k) for k, v in parts.items()))


_ENDED = "list_transform({0}, lambda x: {1} || chr(10))"
_FRAMED = rf"""x AS (SELECT request_id, {_SPLIT.format('code')} AS c, {_SPLIT.format('patch')} AS p FROM api_requests WHERE patch IS NOT NULL AND code IS NOT NULL),
  y AS (SELECT request_id, c, p[coalesce(list_position(list_transform(p, lambda x: starts_with(x, '@@')), true), 0) + 1:] AS p FROM x),
  z AS (SELECT *, list_position(list_transform(p, lambda x: x[1] IN ('+', '-')), true) AS f, len(p) + 1 - list_position(list_reverse(list_transform(p, lambda x: x[1] IN ('+', '-'))), true) AS l FROM y WHERE len(list_filter(p, lambda x: x[1] IN ('+', '-'))) > 0),
  w AS (SELECT request_id, {_ENDED.format('c', 'x')} AS lines, {_ENDED.format("list_filter(p[1:f - 1], lambda x: x[1] = ' ')", 'x[2:]')} AS head, {_ENDED.format("list_filter(p[l + 1:], lambda x: x[1] = ' ')", 'x[2:]')} AS tail,
    {_ENDED.format("list_filter(p[f:l], lambda x: x[1] IN (' ', '-'))", 'x[2:]')} AS base, {_ENDED.format("list_filter(p[f:l], lambda x: x[1] IN (' ', '+'))", 'x[2:]')} AS remote FROM z)"""


def _windows(context: str, anchored: bool = False, tail: bool = False) -> str:
    ls, c = ("list_reverse(lines)", f"list_reverse({context})") if tail else ("lines", context)
    window = f"array_to_string(({ls})[i + 1:{'' if anchored else f' i + len({c})'}], '')"
    return f"CASE WHEN len({c}) > 0 AND len({ls}) >= len({c}) THEN list_transform(range(0, len({ls}) - len({c}) + 1), lambda i: {_DIST.format(window, f"array_to_string({c}, {chr(39) * 2})")}) ELSE [] END"


_START = "CASE WHEN list_min({0}) <= {1} THEN list_position({0}, list_min({0})) - 1 END"


@query(f"""WITH {_FRAMED}, s AS (SELECT request_id, len(lines) AS size, len(head) AS n, len(tail) AS m, len(base) AS nb, len(remote) AS nr, {_windows('head')} AS h, {_windows('tail', tail=True)} AS t, {_windows('head', True)} AS ha, {_windows('tail', True, True)} AS ta, {_windows('base')} AS b, {_windows('remote')} AS r FROM w)
  SELECT request_id, {_START.format('h', 0.75)} + n AS head, size - ({_START.format('t', 0.75)}) - m AS tail, {_START.format('ha', 0.75)} + n AS head_anchored, size - ({_START.format('ta', 0.75)}) - m AS tail_anchored, coalesce({_START.format('b', 0.1)} + nb, {_START.format('r', 0.05)} + nr) AS side_end FROM s""")
def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of the windows nearest to the leading context and starts of those nearest to the trailing one, free and anchored,
    and the end of the base lines or, if they are not there, of the remote lines."""
    at = lambda c, most=0.75, **kw: fuzzy.nearest_window(F.col("lines"), F.col(c), most, **kw)
    end = lambda c, most=0.75, **kw: at(c, most, **kw) + F.size(c)
    start = lambda **kw: F.size("lines") - at("tail", tail=True, **kw) - F.size("tail")
    side = F.coalesce(end("base", 0.1), end("remote", 0.05))
    found = _framed(spark, folder).select("request_id", end("head").alias("h"), start().alias("t"), end("head", anchored=True).alias("head_anchored"), start(anchored=True).alias("tail_anchored"), side.alias("side_end"))
    return found.withColumnsRenamed({"h": "head", "t": "tail"})


@query(f"""WITH {_FRAMED}, s AS (SELECT request_id, len(lines) AS size, len(head) AS n, len(tail) AS m, least(len(base), len(remote)) // 100 AS least_gap, greatest(len(base), len(remote)) * 100 AS most_gap, {_windows('head')} AS h, {_windows('tail', tail=True)} AS t FROM w WHERE greatest(len(base), len(remote)) > 0),
  o AS (SELECT *, {_START.format('h', 0.75)} + n AS a, size - ({_START.format('t', 0.75)}) - m AS b FROM s), hs AS (SELECT request_id, least_gap, most_gap, unnest(h) AS d, generate_subscripts(h, 1) - 1 + n AS at FROM o WHERE a > b), ts AS (SELECT request_id, unnest(list_reverse(t)) AS d, generate_subscripts(t, 1) - 1 AS at FROM o WHERE a > b),
  g AS (SELECT request_id, min_by(hs.at, (hs.d + ts.d, hs.at, ts.at)) AS a2, min_by(ts.at, (hs.d + ts.d, hs.at, ts.at)) AS b2 FROM hs JOIN ts USING (request_id) WHERE hs.d <= 0.75 AND ts.d <= 0.75 AND ts.at - hs.at BETWEEN least_gap AND most_gap GROUP BY request_id)
  SELECT request_id, CASE WHEN a <= b THEN a ELSE a2 END AS first, CASE WHEN a <= b THEN b ELSE b2 END AS last FROM o LEFT JOIN g USING (request_id)""")
def context_range(spark: SparkSession, folder: str) -> DataFrame:
    """Where the patch belongs in the code, by all lines of its leading and trailing context."""
    return fuzzy.context_range(_framed(spark, folder), "request_id", 0.75)


@query(f"""WITH {_FRAMED}, s AS (SELECT request_id, len(lines) AS size, len(head) AS n, len(tail) AS m, len(base) AS nb, len(remote) AS nr, CASE WHEN len(base) = 0 THEN 0.9 ELSE 0.75 END AS cap, least(len(base), len(remote)) // 100 AS least_gap, greatest(len(base), len(remote)) * 100 AS most_gap,
    {_windows('head')} AS h, {_windows('tail', tail=True)} AS t, {_windows('head', True)} AS ha, {_windows('tail', True, True)} AS ta, {_windows('base')} AS b, {_windows('remote')} AS r FROM w),
  o AS (SELECT *, {_START.format('h', 'cap')} + n AS a, size - ({_START.format('t', 'cap')}) - m AS z, {_START.format('ha', 'cap')} + n AS oa, size - ({_START.format('ta', 'cap')}) - m AS oz, coalesce({_START.format('b', 0.1)} + nb, {_START.format('r', 0.05)} + nr) AS side_end FROM s),
  hs AS (SELECT request_id, cap, least_gap, most_gap, unnest(h) AS d, generate_subscripts(h, 1) - 1 + n AS at_h FROM o WHERE a > z AND greatest(nb, nr) > 0), ts AS (SELECT request_id, unnest(list_reverse(t)) AS d, generate_subscripts(t, 1) - 1 AS at_t FROM o WHERE a > z),
  g AS (SELECT request_id, min_by(at_h, (hs.d + ts.d, at_h, at_t)) AS a2, min_by(at_t, (hs.d + ts.d, at_h, at_t)) AS z2 FROM hs JOIN ts USING (request_id) WHERE hs.d <= cap AND ts.d <= cap AND at_t - at_h BETWEEN least_gap AND most_gap GROUP BY request_id),
  p AS (SELECT request_id, CASE WHEN a <= z THEN a ELSE a2 END AS f0, CASE WHEN a <= z THEN z ELSE z2 END AS l0, oa, oz, side_end, greatest(nb, nr) > 0 AS real FROM o LEFT JOIN g USING (request_id)),
  q AS (SELECT request_id, CASE WHEN real AND f0 IS NOT NULL THEN least(f0, oa) END AS f1, CASE WHEN real AND l0 IS NOT NULL THEN greatest(l0, oz) END AS l1, side_end FROM p),
  e AS (SELECT request_id, f1, CASE WHEN side_end > l1 AND side_end <= l1 + 100 THEN side_end ELSE l1 END AS l2 FROM q)
  SELECT conflict_id, min(f1) AS first, max(l2) AS last, count_if(f1 IS NOT NULL AND l2 IS NOT NULL) AS found, count(*) AS pieces FROM e JOIN api_requests USING (request_id) GROUP BY conflict_id""")
def relocate(spark: SparkSession, folder: str) -> DataFrame:
    """Where the patches of each conflict belong in the code: located by context, extended outward, as one hull."""
    whose = table(spark, folder, "api_requests").select("request_id", "conflict_id")
    return fuzzy.relocated(_framed(spark, folder).join(whose, "request_id"), "request_id", "conflict_id")


@query("""WITH r AS (SELECT * FROM answers WHERE commit_type = 'Conflict'), c AS (SELECT * FROM answers WHERE commit_type = 'Clean'),
  l AS (SELECT r.answer_id, max(c.local_end) AS low FROM r LEFT JOIN c ON c.file_path = r.file_path AND c.local_end <= r.local_start GROUP BY r.answer_id), h AS (SELECT r.answer_id, min(c.local_start) AS high FROM r LEFT JOIN c ON c.file_path = r.file_path AND c.local_start >= r.local_end GROUP BY r.answer_id),
  p AS (SELECT file_path, answer_id, greatest(local_start - 10, coalesce(low, 0), 0) AS s, least(local_end + 10, high) AS e FROM r JOIN l USING (answer_id) JOIN h USING (answer_id)),
  o AS (SELECT *, max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o)
  SELECT file_path, island, min(s) AS first, max(e) AS last, count(*) AS members FROM i GROUP BY file_path, island""")
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts with ten lines around them, cut at the clean ranges beside them, and put together where they touch."""
    rows = _answers(spark, folder)
    wide = intervals.padded(rows.where("commit_type = 'Conflict'"), rows.where("commit_type = 'Clean'"), "file_path", "answer_id", "local_start", "local_end", 10)
    return intervals.islands(wide, "file_path", "local_start", "local_end").withColumnsRenamed({"local_start": "first", "local_end": "last"})

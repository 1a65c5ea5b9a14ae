"""Operators against brute force on small random rows, and the registry."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import analytics, contain, diffs, graph, hunks, intervals, namesets, state, validate
from millrace.streaming import results as streaming

SCHEMA = "k string, i long, s long, e long"


@pytest.fixture(scope="module")
def ranges(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        s = rng.randrange(1200)
        rows.append((rng.choice(["f", "f", "g", None]), i, s, s + rng.choice([0, 1, 5, 60, 300])))
    return rows


def test_running_sum(spark, ranges):
    got = {r["i"]: r["x"] for r in intervals.running_sum(spark.createDataFrame(ranges, SCHEMA), "k", "s", "i", F.col("e") - F.col("s"), "x").collect()}
    assert got == {i: sum(e2 - s2 for k2, i2, s2, e2 in ranges if k2 == k and (s2, i2) < (s, i)) for k, i, s, e in ranges}


def test_islands(spark, ranges):
    for gap in (0, 20):
        want = []
        for k in ("f", "g", None):
            reach = None
            for s, e in sorted((s, e) for k2, _, s, e in ranges if k2 == k):
                if reach is None or s > reach + gap:
                    want.append([k, s, e, 0])
                    reach = e
                want[-1][2] = reach = max(reach, e)
                want[-1][3] += 1
        got = [[r["k"], r["s"], r["e"], r["members"]] for r in intervals.islands(spark.createDataFrame(ranges, SCHEMA), "k", "s", "e", gap).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_overlaps(spark, ranges):
    df = spark.createDataFrame(ranges, SCHEMA)
    left, right = df.where("i < 150"), df.where("i >= 150")
    real = [(a, b) for a in ranges[:150] for b in ranges[150:] if a[0] == b[0] is not None and max(a[2], b[2]) < min(a[3], b[3])]
    assert sorted((r[0], r[1]) for r in intervals.overlap_pairs(left, right, "k", "i", "s", "e", width=50).collect()) == sorted((a[1], b[1]) for a, b in real)
    got = {r["i"]: r["overlaps"] for r in intervals.overlap_counts(left.where("k is not null"), right, "k", "i", "s", "e").collect()}
    assert got == {a[1]: sum(x is a for x, _ in real) for a in ranges[:150] if a[0] and a[2] < a[3]}


def test_matches_count_empty_ranges_and_equal_bounds(spark, ranges):
    rows = [*ranges, *(("f", 300 + n, s, e) for n, (s, e) in enumerate([(5, 5), (5, 5), (5, 9), (1, 5), (5, 6), (9, 9), (256, 256), (200, 256), (256, 300), (-3, -3)])), ("f", 400, None, 5)]
    hit = lambda a, b: a[0] == b[0] is not None and None not in (a[2], b[2]) and ((a[2] < b[3] and b[2] < a[3]) or a[2] == b[2] or a[3] == b[3])
    df = spark.createDataFrame(rows, SCHEMA)
    left, right = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]
    want = sorted((a[1], b[1]) for a in left for b in right if hit(a, b))
    assert sorted((r[0], r[1]) for r in intervals.match_pairs(df.where("i % 2 = 1"), df.where("i % 2 = 0"), "k", "i", "s", "e", width=50).collect()) == want
    got = {r["i"]: r["matches"] for r in intervals.match_counts(df.where("i % 2 = 1"), df.where("i % 2 = 0"), "k", "i", "s", "e").collect()}
    assert got == {a[1]: sum(hit(a, b) for b in right) for a in left}
    own = {r["i"]: r["matches"] for r in intervals.match_counts(df, df, "k", "i", "s", "e").collect()}
    assert own == {a[1]: sum(hit(a, b) for b in rows) for a in rows}


def test_names_of_all_earlier_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["f", "f", "g", None]), i, rng.randrange(900), sorted(rng.sample("abcdefg", rng.randrange(1, 4)))) for i in range(150)] + [("f", 150, 5, None), ("h", 151, 9, ["x"]), ("h", 152, 9, ["y"]), ("h", 153, 600, ["x"])]
    want = {}
    for k, i, p, names in rows:
        before = sorted((q, j, other) for k2, j, q, other in rows if k is not None and k2 == k and names and other and (q, j) < (p, i))
        want[i] = (any(set(names) & set(o) for _, _, o in before), next((j for _, j, o in reversed(before) if set(names) <= set(o)), None))
    got = namesets.earlier_sets(spark.createDataFrame(rows, "k string, i long, p long, names array<string>"), "k", "p", "i", "names").collect()
    assert {r["i"]: (r["shares"], r["container"]) for r in got} == want and want[153] == (True, 151)


def test_accept_disjoint(spark, ranges):
    want = set()
    for k in ("f", "g", None):
        reach = None
        for s, e, i in sorted((s, e, i) for k2, i, s, e in ranges if k2 == k):
            if reach is None or s >= reach:
                want.add(i)
                reach = e
    assert {r["i"] for r in intervals.accept_disjoint(spark.createDataFrame(ranges, SCHEMA), "k", "i", "s", "e").collect()} == want


def test_sum_before_and_empty(spark, ranges):
    df = spark.createDataFrame(ranges, SCHEMA).where("k is not null")
    got = {r["i"]: r["total"] for r in intervals.sum_before(df, df, "k", "i", "s", "e", F.col("e") - F.col("s")).collect()}
    assert got == {i: sum(e2 - s2 for k2, _, s2, e2 in ranges if k2 == k and e2 <= s) for k, i, s, e in ranges if k}
    none = df.limit(0)
    assert intervals.islands(none, "k", "s", "e").count() == intervals.overlap_pairs(none, df, "k", "i", "s", "e").count() == intervals.accept_disjoint(none, "k", "i", "s", "e").count() == 0


def test_violations(spark):
    df = spark.createDataFrame([("f", 1, 0, 5), ("f", 2, 4, 6), ("f", 3, 9, 8), ("f", 4, 20, 20), ("f", 5, 20, 20)], SCHEMA)
    assert sorted(tuple(r) for r in intervals.violations(df, "k", "i", "s", "e").collect()) == [(2, "crosses_previous"), (3, "reversed"), (5, "empty_not_apart")]


def test_hunks(spark):
    patch = "note\n@@ -1,3 +1,4 @@ f()\n a\n-b\n+c\n+d\n e\n@@ -9 +10 @@\n-x\n+y\n\\ No newline at end of file\n@@ -20,2 +20,2 @@\n q\n?\n"
    got = [tuple(r) for r in hunks.hunks(spark.createDataFrame([(1, patch)], "id long, p string"), "id", "p").orderBy("hunk").collect()]
    assert got == [(1, 1, 1, 3, 1, 4, 2, 1, 2, 0, True), (1, 2, 9, 1, 10, 1, 0, 1, 1, 0, True), (1, 3, 20, 2, 20, 2, 1, 0, 0, 1, False)]


def apply(diff, before):
    """The text after a unified diff."""
    lines, out, at = before.split("\n"), [], 0
    for raw in diff.split("\n"):
        if raw.startswith("@@"):
            start = int(raw[4:].split(" ")[0].split(",")[0])
            start -= 0 if ",0 " in raw.split("+")[0] else 1
            out += lines[at:start]
            at = start
        elif raw[:1] == "+":
            out.append(raw[1:])
        elif raw[:1] in (" ", "-"):
            assert lines[at] == raw[1:]
            out += [raw[1:]] if raw[0] == " " else []
            at += 1
    return "\n".join(out + lines[at:])


def test_diffs_turn_one_text_into_the_other(spark):
    rng = random.Random(10)
    rows = []
    for i in range(120):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        b = [x for x in a if rng.random() < 0.8] + [rng.choice("abz") for _ in range(rng.randrange(3))]
        rows.append((i, "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)))
    rows += [(900, None, "a"), (901, "a", "a"), (902, "", "")]
    got = {r["i"]: r["diff"] for r in diffs.line_diffs(spark.createDataFrame(rows, "i long, a string, b string"), "i", "a", "b", n=1).collect()}
    assert got[900] is got[901] is got[902] is None
    for i, a, b in rows[:120]:
        assert (apply(got[i], a) if got[i] else a) == b


def test_words_in_order(spark):
    rng = random.Random(12)
    rows = [(0, "a b b c", "a b c"), (1, "a b", "b a"), (2, "x, y", "x y"), (3, "", "p q"), (4, None, "a")]
    rows += [(10 + i, " ".join(rng.choices("abcd", k=rng.randrange(90))), " ".join(rng.choices("abcd", k=rng.randrange(90)))) for i in range(40)]
    want = {}
    for i, a, b in rows:
        if a is not None:
            wa, wb = re.findall(r"\w+", a), re.findall(r"\w+", b)
            best = [[0] * (len(wb) + 1) for _ in range(len(wa) + 1)]
            for m, x in enumerate(wa):
                for n, y in enumerate(wb):
                    best[m + 1][n + 1] = best[m][n] + 1 if x == y else max(best[m][n + 1], best[m + 1][n])
            want[i] = (len(wa) - best[-1][-1], len(wb) - best[-1][-1], best[-1][-1])
    got = {r["i"]: (r["gone"], r["new"], r["kept"]) for r in diffs.word_counts(spark.createDataFrame(rows, "i long, a string, b string"), "i", "a", "b").collect()}
    assert got == want and got[0] == (1, 0, 3) and got[1] == (1, 1, 1)


def test_turned_true(spark):
    schema = "k int, f boolean, at int"
    a = spark.createDataFrame([(0, False, 1), (1, True, 1), (2, False, 1), (2, True, 2), (3, False, 1), (5, False, 1), (5, False, 2), (6, None, 1)], schema)
    b = spark.createDataFrame([(0, True, 7), (1, True, 1), (2, True, 1), (2, True, 1), (3, True, 1), (3, True, 2), (4, True, 1), (5, True, 1), (5, True, 9), (6, True, 1)], schema)
    assert sorted(tuple(r) for r in analytics.turned_true(a, b, ["k"], ["f"], ["at"], ["at"]).collect()) == [(0, 7), (5, 9)]


def test_unfinished(spark):
    items = spark.createDataFrame([(i,) for i in range(4)], "k long")
    done = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "a"), (2, "a"), (3, "x"), (3, "x")], "k long, m string")
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "m string")
    assert sorted(r["k"] for r in analytics.unfinished(items, done, names, "k", "m").collect()) == [2, 3]


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 3), (None, "n", 1)], "k long, v string, at int")
    b = spark.createDataFrame([(1, "z", 0), (3, None, 1)], "k long, v string, at int")
    got = {r["k"]: (r["v"], r["source"]) for r in state.upsert([a, b], ["k"], ["at"]).collect()}
    assert got == {1: ("z", 1), 2: ("b", 0), 3: (None, 1), None: ("n", 0)}


def test_endpoint_rules(spark):
    rows = [(0, "a ", "u", True, 1, 2), (1, "a", "u", None, 3, 2), (2, "", None, False, 1, 1), (3, "b,c", "u", False, None, None)]
    df = spark.createDataFrame(rows, "endpoint_index long, endpoint_name string, url string, is_primary boolean, delay long, max_delay long")
    got = sorted(tuple(r) for r in validate.endpoint_rules(df).collect())
    assert got == [(0, "name_repeated"), (0, "name_untrimmed"), (1, "delay_range"), (1, "name_repeated"), (2, "name_empty"), (2, "url_empty"), (3, "name_characters")]
    assert [r["primary"] for r in validate.primaries(df).orderBy("endpoint_index").collect()] == [True, False, False, False]
    assert all(r["primary"] for r in validate.primaries(df.where("endpoint_index > 1")).collect())


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    day = dt.date(2025, 1, 1)
    write = lambda n, m: spark.createDataFrame([(m, day, True, False)] * n, "model string, run_day date, correct boolean, error boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "results.parquet"))
    write(3, "a")
    for _ in range(2):
        streaming.run_counts(streaming.read_stream(spark, str(tmp_path), "results"), str(tmp_path / "out"), str(tmp_path / "state"))
    write(2, "a")
    streaming.run_counts(streaming.read_stream(spark, str(tmp_path), "results"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [tuple(r) for r in streaming.total_counts(spark, str(tmp_path / "out")).collect()] == [("a", day, 5, 5, 0)]


def test_registry(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "model_stats" in names
    assert entry.entry(spark).count() > 0


def patches():
    rng = random.Random(11)
    rows = []
    for i in range(40):
        text, base, remote = "", 3, 7
        for _ in range(rng.randrange(1, 4)):
            body = [rng.choice([" a", " b", " c", " d", "-x", "+y"]) for _ in range(rng.randrange(1, 25))]
            nb, nr = sum(x[0] != "+" for x in body), sum(x[0] != "-" for x in body)
            text += f"@@ -{base},{nb} +{remote},{nr} @@\n" + "".join(x + "\n" for x in body)
            base, remote = base + nb + 30, remote + nr + 30
        rows.append((i, text))
    return rows


def test_parts_split_at_wide_gaps(spark):
    patch = "@@ -10,8 +10,9 @@\n a\n-b\n c1\n c2\n c3\n+d\n+e\n f\n g\n"
    got = [tuple(r)[2:] for r in hunks.parts(spark.createDataFrame([(1, patch)], "id long, p string"), "id", "p", 2).orderBy("part").collect()]
    assert got == [(1, 10, 5, 10, 4, [" a", "-b", " c1", " c2", " c3"]), (2, 12, 5, 11, 7, [" c1", " c2", " c3", "+d", "+e", " f", " g"])]


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_coalescing_parts_gives_the_hunks_back(spark, gap):
    rows = patches()
    df = spark.createDataFrame(rows, "id long, p string")
    whole = {(r["id"], r["base_start"]): r["body"] for r in hunks.parts(df, "id", "p", 10**6).collect()}
    pieces = hunks.parts(df, "id", "p", gap)
    back = hunks.coalesced(pieces, "id").collect()
    assert pieces.count() > len(whole) and all(r["ok"] for r in back)
    for r in back:
        assert r["base_len"] == sum(x[0] != "+" for x in r["body"]) and r["remote_len"] == sum(x[0] != "-" for x in r["body"])
    if gap:  # parts that share no line on a side stay apart
        assert {(r["id"], r["base_start"]): r["body"] for r in back} == whole


def test_coalescing_refuses_what_does_not_fit(spark):
    schema = "id long, base_start long, base_len long, remote_start long, remote_len long, body array<string>"
    fit = [(1, 1, 3, 1, 3, [" a", "-b", "+B", " c"]), (1, 3, 3, 3, 3, [" c", "-d", "+D", " e"])]
    other_text = [(2, 1, 3, 1, 3, [" a", "-b", "+B", " c"]), (2, 3, 3, 3, 3, [" x", "-d", "+D", " e"])]
    uneven = [(3, 1, 3, 1, 3, [" a", "-b", "+B", " c"]), (3, 3, 3, 2, 3, [" c", "-d", "+D", " e"])]
    beyond = [(4, 1, 3, 1, 3, [" a", " c", "-b", "+B"]), (4, 3, 3, 3, 3, ["-b", "+D", " e", " f"])]
    apart = [(5, 1, 2, 1, 2, [" a", "-b", "+B"]), (5, 3, 2, 3, 2, ["-d", "+D", " e"])]
    got = {}
    for r in hunks.coalesced(spark.createDataFrame(fit + other_text + uneven + beyond + apart, schema), "id").collect():
        got.setdefault(r["id"], []).append((r["base_start"], r["base_len"], r["ok"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 5, True)], **{k: [(1, 3, True), (3, 3, False)] for k in (2, 3, 4)}, 5: [(1, 2, True), (3, 2, True)]}


def test_rendered_hunks_parse_back(spark):
    df = spark.createDataFrame(patches(), "id long, p string")
    cut = hunks.parts(df, "id", "p", 1)
    text = cut.select("id", "part", "hunk", "base_start", hunks.rendered(*(F.col(c) for c in ("base_start", "base_len", "remote_start", "remote_len", "body"))).alias("p"))
    again = hunks.hunks(text.withColumn("key", F.concat_ws("/", "id", "hunk", "part")).drop("hunk"), "key", "p").collect()
    assert len(again) == cut.count() and all(r["valid"] for r in again)


def test_components(spark):
    rng = random.Random(12)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(links, "x long, y long")
    assert {r["node"]: r["root"] for r in graph.components(df, "x", "y").collect()} == {n: find(n) for n in list(root)}
    assert graph.components(df.limit(0), "x", "y").count() == 0


def test_one_file_holds_all_ranges(spark):
    """Order-bound operators on one hot key: rows are sorted by blocks and islands, never by the key alone."""
    rng = random.Random(11)
    rows = [("f", i, s, s + rng.choice([0, 0, 1, 3, 9, 700]), "x") for i, s in enumerate(rng.randrange(3000) for _ in range(800))]
    df = spark.createDataFrame(rows, "k string, i long, s long, e long, w string")
    order = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    got = {r["i"]: (r["previous_end"], r["next_start"]) for r in intervals.gaps_around(df, "k", "i", "s", "e", 9999).collect()}
    ends, starts = [0, *(r[3] for r in order)], [*(r[2] for r in order), 9999]
    assert got == {r[1]: (ends[n], starts[n + 1]) for n, r in enumerate(order)}
    kept, reach = set(), None
    for r in order:
        if reach is None or r[2] >= reach:
            kept.add(r[1])
            reach = r[3]
    accepted = intervals.accept_disjoint(df, "k", "i", "s", "e")
    assert {r["i"] for r in accepted.collect()} == kept
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert "island" in plan and all("_block" in w for w in plan.split("Window [")[1:] if "windowspecdefinition(k" in w.split("\n")[0] and ", s#" in w.split("\n")[0])


def test_first_containing(spark):
    texts = [(5, "see xlib/lock.cc now"), (3, "a lib/lock.c b"), (7, "deadbeef99"), (8, None), (9, ""), (2, "lock alone"), (6, "über/größe.x ab")]
    needles = ["lib/lock.c", "lock", "beef", "dbeef9", "zz", "", None, "größe.x", "b", "a lib"]
    df = spark.createDataFrame(texts, "i long, t string")
    got = {r["s"]: r["i"] for r in contain.first_containing(df, "i", "t", spark.createDataFrame([(n,) for n in needles * 2], "s string"), "s").collect()}
    assert got == {n: min((i for i, t in texts if t and n in t), default=None) for n in needles if n}
    assert contain.first_containing(df.limit(0), "i", "t", df.select("t"), "t").where("i is not null").count() == 0


def test_coalescing_keeps_pieces_with_other_flags_apart(spark):
    schema = "id long, base_start long, base_len long, remote_start long, remote_len long, body array<string>, clean boolean"
    piece = lambda i, at, clean: (i, at, 3, at, 3, [f" {at}", f"-{at + 1}", f"+n{at + 1}", f" {at + 2}"], clean)
    rows = [piece(1, 1, True), piece(1, 3, True), piece(1, 5, False), piece(1, 7, False), piece(2, 1, None), piece(2, 3, None)]
    got = {}
    for r in hunks.coalesced(spark.createDataFrame(rows, schema), "id", "clean").collect():
        got.setdefault(r["id"], []).append((r["base_start"], r["base_len"], r["remote_len"], len(r["body"]), r["ok"], r["clean"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 5, 5, 7, True, True), (5, 5, 5, 7, False, False)], 2: [(1, 5, 5, 7, True, None)]}

"""Checks of answers, marked regions, nested values and padded ranges on small rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.functions import nested
from millrace.operators import acceptance, diffs, fuzzy, intervals, regions

CODE = "a\nb\nold\ny\nz\n"
TAG, END = "<|patched_code|>\n", "<|/patched_code|>"


def judged(spark, responses, patch="@@ -1 +1 @@\n-old\n+new\n", code=CODE, context=2):
    rows = spark.createDataFrame([(i, r, patch, code) for i, r in enumerate(responses)], "id long, r string, p string, c string")
    return [(r["id"], r["block"], r["reason"], r["resolved"]) for r in acceptance.judged_blocks(rows, "id", "r", "p", "c", context).orderBy("id", "block").collect()]


def test_first_reason_of_each_block(spark):
    block = lambda body: f"{TAG}{body}{END}\n"
    responses = [
        block("a\nb\nnew\ny\nz\n"), "no block", block("b\nnew\ny\nz\n"), block("a\nb\nnew\ny\n"), block("a\nb\nold\ny\nz\n"), block("a\nb\n+new\ny\nz\n"),
        block("a\nb\nnew\ny\nz\n") + block("a\nb\nnew\ny\nz\n") + TAG + "open", None, "```{patched_code}\na\nb\nnew\ny\nz\n{/patched_code}```\n", "text <|patched_code|>\nx" + END,
    ]
    got = judged(spark, responses)
    assert [(i, b, r) for i, b, r, _ in got] == [
        (0, 0, None), (1, None, "no_block"), (2, 0, "head_context"), (3, 0, "tail_context"), (4, 0, "no_change"), (5, 0, "like_patch"), (6, 0, None), (6, 1, "repeated"), (7, None, "no_block"), (8, 0, None), (9, None, "no_block"),
    ]
    assert got[0][3] == "new\n"


def test_line_ends_may_be_added(spark):
    code = "\n\nx\nmid\nu\n\n\n"
    got = judged(spark, [f"{TAG}\nx\nnew\nu\n\n{END}\n", f"{TAG}x\nnew\nu\n{END}\n"], code=code, context=3)
    assert [(r, v) for _, _, r, v in got] == [(None, "new\n"), ("head_context", None)]


def test_retries(spark):
    rows = [(1, None, 0, 0, True), (2, "no_block", None, 0, True), (2, None, 0, 0, False), (3, "head_context", 1, 0, True), (4, "like_patch", 0, 0, False), (5, "like_patch", 0, 1, False), (6, "no_block", None, 0, None)]
    df = spark.createDataFrame(rows, "g long, reason string, block int, beam long, first boolean")
    assert {r["g"]: (r["accepted"], r["retry"]) for r in acceptance.retries(df, "g", "first", "beam").collect()} == {1: (1, False), 2: (1, True), 3: (0, False), 4: (0, True), 5: (0, False), 6: (0, True)}


def test_regions_with_answers_context_and_errors(spark):
    region = lambda base, answers: "<<<<<<< l\nU\n" + ("||||||| b\nB\n" if base else "") + "=======\nL\n" + answers + ">>>>>>> r\n"
    texts = ["h1\nh2\nh3\n" + region(True, "") + "m\n" + region(False, "&&&&&&& x\nA1\n&&&&&&& y\nA2\n") + "t", "<<<<<<< a\n<<<<<<< b\n=======\n>>>>>>> c\n", "<<<<<<< a\nx\n", "<<<<<<< a\n>>>>>>> c\n", "<<<<<<< a\n=======\n||||||| b\n>>>>>>> c\n", "plain", "", None]
    rows = regions.parsed(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t", 2).orderBy("i", "region").collect()
    assert [(r["i"], r["region"], r["error"]) for r in rows] == [(0, 1, None), (0, 2, None), (1, 1, "nested"), (1, 2, None), (2, 1, "open"), (3, 1, "no_lower"), (4, 1, "unordered")]
    one, two = rows[:2]
    assert (one["upper"], one["base"], one["lower"], one["answers"], one["answer"], one["head"], one["tail"], one["upper_start"]) == ("U\n", "B\n", "L\n", 0, None, "h2\nh3\n", "m\n", 3)
    assert (two["base"], two["answers"], two["answer"], two["head"], two["tail"], two["upper_start"]) == (None, 2, "A1\n", "m\n", "t", 5)


def test_nested_values(spark):
    texts = ['{"a":{"Signature":1,"b":[{"xSIGNATUREx":{"c":2},"d":3}]}}', "[1]", "no json", None, "3", '[{"k":1},{"k":"u","v":"w","z":{"k":"q","v":"r"}}]']
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["t"] for r in nested.redacted(df, "i", "t", "signature").collect()}
    assert got == {0: '{"a":{"Signature":null,"b":[{"xSIGNATUREx":null,"d":3}]}}', 1: "[1]", 2: None, 3: None, 4: "3", 5: texts[5]}
    got = {r["i"]: r["t"] for r in nested.first_object(df, "i", "t", ["k", "v"]).collect()}
    assert got[5] == '{"k":"u","v":"w","z":{"k":"q","v":"r"}}' and got[0] is got[4] is None
    assert nested.redacted(df.limit(0), "i", "t", "x").count() == 0


def test_ranges_are_widened_up_to_the_fences(spark):
    ranges = spark.createDataFrame([("f", 1, 20, 25), ("f", 2, 3, 3), ("g", 3, 50, 60), ("f", 4, 27, 30)], "k string, i long, s long, e long")
    fences = spark.createDataFrame([("f", 12, 15), ("f", 31, 33), ("f", 0, 1), ("h", 1, 2), ("f", 21, 22)], "k string, s long, e long")
    got = {r["i"]: (r["s"], r["e"]) for r in intervals.padded(ranges, fences, "k", "i", "s", "e", 10).collect()}
    assert got == {1: (15, 31), 2: (1, 12), 3: (40, 70), 4: (22, 31)}
    assert intervals.padded(ranges.limit(0), fences, "k", "i", "s", "e", 10).count() == 0


def test_pieces_are_located_and_only_extended(spark):
    lines = [f"line {i} of the file\n" for i in range(12)]
    arrays = "lines array<string>, head array<string>, tail array<string>, base array<string>, remote array<string>"
    rows = [(1, 7, lines, lines[2:4], lines[6:8], lines[4:6], ["new\n"]), (2, 7, lines, lines[7:8], lines[9:11], lines[8:9], ["x\n"]), (3, 8, lines, ["nowhere to be found at all\n"], ["also not\n"], lines[1:2], ["q\n"])]
    got = {r["g"]: (r["first"], r["last"], r["found"], r["pieces"]) for r in fuzzy.relocated(spark.createDataFrame(rows, f"i long, g long, {arrays}"), "i", "g").collect()}
    assert got == {7: (4, 9, 2, 2), 8: (None, None, 0, 1)}


def test_alignment_is_longest(spark):
    for a, b, n in (("abcbdab", "bdcaba", 4), ("", "x", 0), ("xay", "xby", 2), ("abc", "abc", 3), ("aaaa", "aa", 2)):
        pairs = diffs.aligned(list(a), list(b))
        assert len(pairs) == n and all(a[x] == b[y] for x, y in pairs) and pairs == sorted(pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == n
    df = spark.createDataFrame([(1, "a\nb", "a\nb\n"), (2, None, "x"), (3, "", "q")], "i long, a string, b string")
    got = {r["i"]: r["diff"] for r in diffs.line_diffs(df, "i", "a", "b", n=1).collect()}
    assert got[1] == "@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+b\n" and got[2] is None and got[3] == "@@ -0,0 +1 @@\n+q\n\\ No newline at end of file\n"
    assert diffs.line_script(df, "i", "a", "b").where(F.col("sign") == " ").count() == 1


def test_suffix_distances():
    rng = random.Random(2)
    for _ in range(200):
        text, wanted = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        got = fuzzy.suffix_distances(text, wanted, 20)
        for j, d in enumerate(got):
            end = text[len(text) - j :]
            row = list(range(len(wanted) + 1))
            for i, x in enumerate(end, 1):
                prev, row = row, [i]
                for k, y in enumerate(wanted, 1):
                    row.append(min(prev[k] + 1, row[k - 1] + 1, prev[k - 1] + (x != y)))
            assert d == row[-1]
        assert len(got) == len(text) + 1

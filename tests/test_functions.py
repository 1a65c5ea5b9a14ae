"""Golden cases of scalar functions, on rows made up here."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import scores
from millrace.functions import text as tx
from millrace.operators import consensus, fuzzy, intervals, regions
from millrace.sources import csv


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_score_percent(spark):
    got = values(spark, [(0.0,), (-0.5,), (1.0,), (None,)], "x double", scores.score_percent(F.col("x")))
    assert got[0] == got[2] == 100 and math.isclose(got[1], 0.1) and got[3] is None


def test_usable(spark):
    assert values(spark, [(0.0,), (2.5,), (float("nan"),), (float("inf"),), (None,)], "x double", scores.usable(F.col("x"))) == [None, 2.5, None, None, None]


def test_space(spark):
    assert values(spark, [("a b\n\tc\x85d e\x1cf",), (None,)], "t string", tx.without_space(F.col("t"))) == ["abcde\x1cf", None]
    assert values(spark, [("  a   b \n\n\tc",), ("",), ("　x　 y　\n ",)], "t string", tx.aligned(F.col("t"))) == ["  a b\n\tc", "", "　x y"]


def test_lines(spark):
    rows = [("a\nb",), ("a\n",), ("",), ("\n\n",)]
    assert values(spark, rows, "t string", tx.lines_of(F.col("t"))) == [["a\n", "b"], ["a\n"], [], ["\n", "\n"]]
    assert values(spark, rows, "t string", tx.bare_lines(F.col("t"))) == [["a", "b"], ["a"], [], ["", ""]]


def test_blocks(spark):
    rows = [("x <|k|>\na\n<|/k|> y <|k|>\nb<|/k|> <|k|>\nopen",), ("none",), (None,)]
    assert values(spark, rows, "t string", tx.blocks(F.col("t"), "k")) == [["a\n", "b"], [], None]


def test_line_start(spark):
    rows = [("b", "a\nb c\n"), ("a", "a\na"), ("c", "ab c"), ("", "x"), ("a\nb", "z\na\nb")]
    assert values(spark, rows, "n string, t string", tx.line_start(F.col("n"), F.col("t"))) == [2, None, None, None, 2]


def test_sides(spark):
    patch = "@@ -1,2 +1,2 @@\n a\n-b\n+c\n d"
    assert values(spark, [(patch,)], "p string", tx.side_of(F.col("p"), " -")) == ["a\nb\nd"]
    assert values(spark, [(patch,)], "p string", tx.side_of(F.col("p"), " +")) == ["a\nc\nd"]
    head, tail = tx.context_sizes(F.col("p"))
    assert values(spark, [(patch,), ("@@ -1 +1 @@\n a",)], "p string", head) == [1, None]
    assert values(spark, [(patch,)], "p string", tail) == [1]


def test_content_key_parts_do_not_run_together(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")]
    a, b, c, d = values(spark, rows, "x string, y string", tx.content_key(F.col("x"), F.col("y")))
    assert len({a, b, c}) == 3 and c == d


@pytest.mark.parametrize(("r", "adjacent", "want"), [((1, 3, 3, 5), True, True), ((1, 3, 3, 5), False, False), ((2, 2, 2, 4), False, True), ((1, 9, 3, 4), False, True), ((4, 4, 1, 4), False, True), ((1, 2, 5, 6), True, False)])
def test_ranges_overlap(spark, r, adjacent, want):
    assert values(spark, [r], "a int, b int, c int, d int", intervals.ranges_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"), adjacent)) == [want]


def test_answer_label(spark):
    rows = [("m", 1, 2, 3), ("m", 0, 0, 0), ("m", None, 2, None)]
    assert values(spark, rows, "n string, v int, b int, k int", consensus.answer_label(*(F.col(c) for c in "nvbk"))) == ["m (1#2$3)", "m", "m (#2)"]


def test_whole_means_and_labels(spark):
    rows = [("f", 1, "t", 5, 1, None, 9, 0, 0, "A (x)", 1.0, False), ("f", 1, "t", None, 2, -1.0, 3, 0, 0, "B", 2.0, True), ("f", 1, "t", 6, 3, float("nan"), 4, 0, 0, "A (y), B", 0.5, True), ("f", 1, "u", 1, 4, 0.0, 1, 0, 1, "C", 0.0, False)]
    df = spark.createDataFrame(rows, "file_path string, local_start long, resolved_version string, input_tokens long, answer_id long, logprob double, endpoint_index long, multi_index long, beam_index long, model string, duration double, no_change boolean").withColumn("output_tokens", F.lit(1).cast("long"))
    (g,) = consensus.grouped(consensus.first_answers(df)).collect()
    assert (g["members"], g["input_tokens"], g["logprob"], g["endpoint_index"], g["first_id"], g["duration"], g["adapted"]) == (3, 5, -1.0, 3, 1, 2.0, True)
    assert consensus.merged_labels(df, ["file_path"]).first()["label"] == "A (x|y), B, C"


def test_regions(spark):
    text = "a\n<<<<<<< x\n1\n2\n||||||| b\n0\n=======\n3\n>>>>>>> y\nb\n<<<<<<< x\n=======\n4\n>>>>>>> y\n<<<<<<<< not\n<<<<<<< open\n5\n"
    (got,) = values(spark, [(text,)], "t string", regions.regions(F.col("t")))
    assert [tuple(r) for r in got] == [("1\n2\n", "0\n", "3\n"), ("", "", "4\n")]
    side = lambda s: values(spark, [(text,)], "t string", regions.one_side(F.col("t"), s))[0]
    assert side("upper").startswith("a\n1\n2\nb\n<<<<<<<< not") and side("lower").startswith("a\n3\nb\n4\n") and side("base").startswith("a\n0\nb\n<")


def test_spliced(spark):
    files = spark.createDataFrame([("f", "a\nb\nc\nd"), ("g", "x\n"), ("h", None)], "k string, t string")
    edits = spark.createDataFrame([("f", 0, 1, "A\nA\n"), ("f", 2, 4, "C\n"), ("f", 1, 1, "new\n")], "k string, start long, end long, replacement string")
    assert dict(regions.spliced(files, edits, "k", "t").collect()) == {"f": "A\nA\nnew\nb\nC\n", "g": "x\n", "h": None}


def test_best_pair(spark):
    rows = [(["end", "start", "mid", "end"], "start", "end"), ([], "a", "b"), (["a"], "a", "b")]
    got = values(spark, rows, "l array<string>, h string, t string", fuzzy.best_pair(F.col("l"), F.col("h"), F.col("t")))
    assert tuple(got[0]) == (0.0, 1, 3) and got[1] is None and got[2]["head"] == got[2]["tail"] == 0


def test_windows_of_the_whole_context(spark):
    schema = "i int, lines array<string>, head array<string>, tail array<string>, base array<string>, remote array<string>"
    code = ["}\n", "aaaa\n", "}\n", "bbbb\n", "xxxx\n", "cccc\n", "}\n", "dddd\n", "}\n"]
    rows = [(1, code, ["}\n", "bbbb\n"], ["cccc\n", "}\n"], ["xxxx\n"], ["y\n"]), (2, code, [], ["}\n"], ["x\n"], []), (3, code, ["dddd\n"], ["aaaa\n"], ["x\n"], [])]
    got = {r["i"]: (r["first"], r["last"]) for r in fuzzy.context_range(spark.createDataFrame(rows, schema), "i", 0.5).collect()}
    assert got == {1: (4, 5), 2: (None, None), 3: (None, None)}  # the first and last brace alone would give the wrong place
    start = lambda **kw: fuzzy.best_start(fuzzy.window_scores(F.col("l"), F.col("c"), **kw), 0.5)
    both = lambda ls, c, **kw: values(spark, [(ls, c)], "l array<string>, c array<string>", start(**kw))
    assert both(["b\n", "a\n", "b\n"], ["b\n"]) == both(["b\n", "a\n", "b\n"], ["b\n"], tail=True) == [0]
    assert both(["b\n", "a\n", "c\n"], ["a\n", "c\n"], anchored=True) == [1] and both(["zz\n"], ["abcdef\n"]) == [None]
    pair = lambda least, longest: values(spark, [([0.1, 0.5], [0.0, 0.1, 0.3, 0.2])], "h array<double>, t array<double>", fuzzy.bounded_pair(F.col("h"), F.col("t"), F.lit(1), F.lit(least), F.lit(longest), 0.4))[0]
    assert tuple(pair(0, 9))[1:] == (1, 1) and tuple(pair(1, 1))[1:] == (1, 2) and tuple(pair(1, 9))[1:] == (1, 3) and pair(3, 9) is None


def test_sources(spark, tmp_path):
    rows = [(1, "a,\"b\"\nc", True, False, None, 1.5, 3, None, -0.5, "x\ny", False, "p", "c^")]
    df = spark.createDataFrame(rows, csv.RESULT_SCHEMA)
    csv.write_results(df, str(tmp_path / "r"))
    assert csv.read_results(spark, [str(tmp_path / "r"), str(tmp_path / "none")]).collect() == df.collect()
    assert csv.read_results(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "t.csv").write_text('id,run,description,patch,code,patched_code\n1,r,"abc / def\nlib/x.c"," a\n",c,d\n2,r,only\n')
    (got,) = csv.read_test_set(spark, str(tmp_path / "t.csv")).collect()
    assert (got["code_commit_hash"], got["patch_commit_hash"], got["filename"], got["patch"]) == ("abc^", "def", "lib/x.c", " a\n")
    (tmp_path / "s").write_text("u UU N... 1 2 3 4 h1 h2 h3 a b.c\0 1 A x\0u UU N... 1 2 3 4 k1 k2 k3 d\0")
    assert sorted(tuple(r) for r in csv.status_entries(spark, str(tmp_path / "s")).collect()) == [("h2", "a b.c"), ("k2", "d")]


def test_commit_pairs(spark):
    h = lambda c: c * 40
    lines = [f"commit {h('a')}", "  text", f"  commit {h('b')} upstream.", f"  [ Upstream commit {h('c')} ]", f"commit {h('d')}", "", f"commit {h('e')}", f"    [ Upstream commit {h('f')} ]"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "log int, n long, line string")
    assert {r["commit"]: r["upstream"] for r in csv.commit_pairs(df, "n", "line", "log").collect()} == {h("a"): h("b"), h("e"): h("f")}

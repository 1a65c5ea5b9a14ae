"""Rejected records and differences between copies, on small rows and by brute force."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import compare, rejects

PATCH = "@@ -1,2 +1,2 @@\n a\n-b\n+c\n"


def record(patch=PATCH, code="x", patched="int a;\n", n=6):
    q = lambda s: '"' + s.replace('"', '""') + '"'
    return ",".join([q("1"), q("run"), q("d"), q(patch), q(code), q(patched)][:n] + ["z"] * (n - 6))


def reasons(spark, rows):
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(rows)], "id long, raw string, reason string")
    return {r["id"]: r["reason"] for r in rejects.rejected(df, "id", "raw").collect()}


def test_reasons(spark):
    rows = {
        record(): None,
        '1,run,d," a\n",x,y': None,
        "1,run,d, a,x,y": None,
        record(n=5): "column_count",
        record(n=7): "column_count",
        "": "column_count",
        None: "column_count",
        '1,run,d,"a"b,x,y': "quoting",
        '1,run,d,a"b,x,y': "quoting",
        '1,run,d,"open,x,y': "quoting",
        record() + "\n": "quoting",
        record(patch=""): "invalid_value",
        record(patch="\n"): "invalid_value",
        record(patch=" a\n\n"): "invalid_value",
        record(patch=" a\nb"): "invalid_value",
        record(patch="@@ -1 +1 @@ f()\n+a"): None,
        record(patch="@@ -x +1 @@"): "invalid_value",
        record(patched=""): "invalid_value",
        record(patched="   \n"): "invalid_value",
        record(patched="a�b"): "invalid_value",
        record(patched="a\x07b"): "invalid_value",
        record(patched="a\x85b"): "invalid_value",
        record(patched="a\tb\r\nc"): None,
        record(patched="a\n<<<<<<< x"): "invalid_value",
        record(patched="======="): "invalid_value",
        record(patched="a <<<<<<< x"): None,
        record(patched='say "hi", he\n' * 3): None,
    }
    assert reasons(spark, list(rows)) == {i: want for i, want in enumerate(rows.values()) if want}


def test_long_field_and_repeats(spark):
    long = record(patched='x "" y\n' * 200_000)
    assert reasons(spark, [long, long, record(n=5), record(n=5)]) == {2: "column_count", 3: "column_count"}


def test_loaded_and_rejected_part_the_rows(spark):
    df = spark.createDataFrame([(1, record(patched='a "b"')), (2, record(patch="x")), (3, None)], "id long, raw string")
    good = rejects.loaded(df, "id", "raw").collect()
    assert [(r["id"], r["patched_code"], r["patch"]) for r in good] == [(1, 'a "b"', PATCH)]


def test_empty_records(spark):
    df = spark.createDataFrame([], "id long, raw string")
    assert rejects.rejected(df, "id", "raw").count() == 0 and rejects.loaded(df, "id", "raw").count() == 0


def at(n):
    return dt.datetime(2025, 1, 1, 0, 0, n)


def found(spark, a, b):
    schema = "entry long, model string, x boolean, y boolean, at timestamp, difference string"
    da, db = (spark.createDataFrame([(*r, "clash") for r in rows], schema) for rows in (a, b))
    keys = {"entry": F.col("entry"), "model_key": F.lower(F.trim("model"))}
    return sorted((r["entry"] if r["entry"] is not None else -1, r["model_key"] or "", r["difference"]) for r in compare.differences(da, db, keys, ["x", "y"], latest="at").collect())


def test_differences(spark):
    a = [(1, "M", True, None, at(1)), (2, "m ", True, True, at(1)), (2, "M", False, True, at(2)), (3, "m", True, True, at(1)), (None, None, True, True, at(1)), (5, "m", None, None, None), (5, "m", True, False, at(1)), (5, "m", True, False, at(1))]
    b = [(1, "m", True, False, at(9)), (2, "m", True, True, at(1)), (4, "m", True, True, at(1)), (None, None, True, False, at(1)), (5, "m", True, False, at(1))]
    assert found(spark, a, b) == [(-1, "", "y"), (1, "m", "y"), (2, "m", "x"), (3, "m", "missing_in_b"), (4, "m", "missing_in_a")]


def test_differences_of_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "m", True, True, at(1))], []) == [(1, "m", "missing_in_b")]


def test_only_one_shuffle(spark):
    df = spark.createDataFrame([(1, True)], "k long, x boolean")
    plan = compare.differences(df, df, {"k": F.col("k")}, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_values_are_cast_once_each(spark, monkeypatch):
    """The check reads the table of distinct values: with ten copies of each record it sees each value once."""
    seen = []
    write = rejects.materialize
    monkeypatch.setattr(rejects, "materialize", lambda df, label="table": seen.append((label, write(df, label))) or seen[-1][1])
    df = spark.createDataFrame([(i, record(patch=" a\n" * (i % 3 + 1), patched="\x07" if i % 3 else "int a;")) for i in range(30)], "id long, raw string")
    assert {r["reason"] for r in rejects.rejected(df, "id", "raw").collect()} == {"invalid_value"}
    tables = dict(seen)
    assert tables["values"].count() == 3 + 2 and tables["invalid"].count() == 1
    assert "raw" not in tables["invalid"]._jdf.queryExecution().optimizedPlan().toString()

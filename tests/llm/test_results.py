"""Top items and percentiles against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

from millrace.llm import percentiles as pc
from millrace.llm.top_n import top_n

NAN = float("nan")


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i % 90, rng.choice(["a", "B", None]), rng.choice([0.5, -1.0, 2.0, NAN, None, -0.0, 0.0]), "x") for i in range(400)]
    seen, single = set(), []
    for r in rows:  # a repeated item keeps its first row here, so that copies are true copies
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            single.append(r)
    df = spark.createDataFrame(single + single[:50], "g long, i long, m string, s double, rank string")
    want = defaultdict(list)
    for g, i, m, s, _ in single:
        if s is not None and not math.isnan(s):
            want[g].append((-s + 0.0, m is None, (m or "").encode(), i))
    want = {g: [x[3] for x in sorted(v)[:5]] for g, v in want.items()}
    for subgroups in (1, 3, 64):
        got = defaultdict(dict)
        for r in top_n(df, "g", "i", "s", 5, ties=["m"], subgroups=subgroups).collect():
            got[r["g"]][r["rank"]] = r["i"]
        assert {g: [v[k] for k in sorted(v)] for g, v in got.items()} == want


def test_top_n_counts_an_item_once_by_its_best_row(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 7, 3.0), (1, 8, 2.0), (1, 7, None)], "g long, i long, s double")
    assert [(r["i"], r["s"]) for r in top_n(df, "g", "i", "s", 5).orderBy("rank").collect()] == [(7, 3.0), (8, 2.0)]
    assert top_n(df.limit(0), "g", "i", "s", 5).count() == 0


def brute(rows, percents):
    groups = defaultdict(list)
    for item, g, p, *values in {r[0] if r[0] is not None else (i,): r for i, r in enumerate(rows)}.values():
        for m, v in enumerate(values):
            if v is not None and not math.isnan(v):
                groups[g, p, "part", f"v{m}"].append(float(v))
                groups[g, None, "all", f"v{m}"].append(float(v))
    return {(*k, q): (len(v), sorted(v)[max(1, math.ceil(q * len(v) / 100)) - 1]) for k, v in groups.items() for q in percents}


def check(spark, rows, percents=(1, 50, 90, 99, 100)):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "item long, g string, p long, v0 double, v1 long, value string")
    got = pc.percentiles(df, "g", "p", ["v0", "v1"], percents, item="item").collect()
    found = {(r["g"], r["p"], r["scope"], r["measure"], r["percent"]): (r["n"], r["value"]) for r in got}
    assert len(found) == len(got) and found == brute(rows, percents)


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", None]), rng.choice([1, 2, None]), rng.choice([NAN, None, 0.0, rng.lognormvariate(0, 9), rng.random()]), rng.choice([None, 5, rng.randrange(9000)])) for i in range(700)]
    check(spark, rows + rows[:60])


def test_percentiles_of_odd_groups(spark):
    inf = float("inf")
    check(spark, [(1, "x", 1, 3.0, None), (2, "y", 1, inf, 1), (3, "y", 1, -inf, 1), (4, "y", 1, 0.0, 2), (5, "y", 2, 1e300, 2), (6, "y", 2, -1e300, 2), (7, "y", 2, inf, 3), (8, "z", 1, NAN, None)])
    df = spark.createDataFrame([], "item long, g string, p long, v0 double")
    assert pc.percentiles(df, "g", "p", ["v0"], [50], item="item").count() == 0


def test_percentiles_with_fewer_values_from_pass_to_pass(spark, monkeypatch):
    monkeypatch.setattr(pc, "HALVINGS", 2)
    monkeypatch.setattr(pc, "FEWEST_HALVINGS", 1)
    check(spark, [(i, ["a", "b", None][i % 3], i % 2, float(i * i % 101), i % 7) for i in range(300)])


def test_percentiles_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pc, "BROADCAST_BYTES", 0)
    check(spark, [(i, "ab"[i % 2], i % 3, float(i * i % 101), i) for i in range(300)])

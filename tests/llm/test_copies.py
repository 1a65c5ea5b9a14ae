"""Near-duplicates and formatting duplicates against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from millrace.llm import format_dups, near_dups


def words(rng, n):
    return [rng.choice(["get", "put", "Lock", "if", "x_1", "return"]) + str(rng.randrange(400)) for _ in range(n)]


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = "new" + str(rng.randrange(10**6))
    return ws


def shingles(fields, k):
    out = set()
    for f in fields:
        w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", f or "")]
        out |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def entries(seed=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(60):
        base = [words(rng, 60), words(rng, 40), words(rng, 30)]
        for n in (0, 0, 1, 2, 4, 9):
            fields = [" ".join(edited(rng, f, n)) for f in base]
            rows.append((i, fields[0], fields[1].upper() if n == 0 and rng.random() < 0.5 else fields[1], fields[2] + " ;\r\n", "clash"))
            i += 1
    return rows + [(i, None, "", "a b", "c"), (i + 1, None, None, None, "c"), (i + 2, "a b c", "", None, "c"), (i + 3, "", "A-b\tC", "", "c"), (i + 4, "é a b ü c d", None, "x" * 200_000, "c")]


def brute(rows, k, percent):
    sets = {r[0]: shingles(r[1:4], k) for r in rows}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if (u := len(sets[a] | sets[b])) and len(sets[a] & sets[b]) * 100 >= u * percent}


def test_shingle_hashes_follow_the_words():
    texts = ["Ab c_1 d", None, "", "x", "a b c d e", "a-b c\nd é e f", "zz a b", "A B C"]
    h, row = near_dups.shingle_hashes(*near_dups._bytes_of(pa.array(texts)), 3)
    want = []
    for i, t in enumerate(texts):
        w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", t or "")]
        want += [(i, tuple(w[j : j + 3])) for j in range(len(w) - 2)]
    assert [i for i, _ in want] == list(row)
    pairs = list(zip((w for _, w in want), h.tolist(), strict=True))
    assert len({w for w, _ in pairs}) == len({x for _, x in pairs}) == len(set(pairs))


def test_allocate_is_optimal():
    cost = [[5, 9, 30], [1, 2, 50], [4, 4, 4]]
    best = min(
        (sum(c[t] for c, t in zip(cost, ts, strict=True) if t >= 0), ts)
        for ts in [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3)]
        if sum(t + 1 for t in ts) >= 5
    )
    got = near_dups.allocate(cost, 5)
    assert sum(c[t] for c, t in zip(cost, got, strict=True) if t >= 0) == best[0] and sum(t + 1 for t in got) >= 5


def test_near_pairs_and_groups(spark):
    rows = entries()
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, class string")
    near = near_dups.NearDuplicates(df, "id", ["a", "b", "c"], k=3, percent=70)
    want = brute(rows, 3, 70)
    got = [(r["a"], r["b"]) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    root = {}
    for a, b in sorted(want):
        ra, rb = root.get(a, a), root.get(b, b)
        low = min(ra, rb)
        for x in [x for x in {*root, a, b} if root.get(x, x) in (ra, rb)]:
            root[x] = low
    groups = {r["id"]: r["group"] for r in near.groups().collect()}
    assert groups == {r[0]: root.get(r[0], r[0]) for r in rows if shingles(r[1:4], 3)}


def test_hot_signatures_lose_no_pair(spark, monkeypatch):
    rows = entries(5)
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, class string")
    monkeypatch.setattr(near_dups, "HOT", 2)
    got = {(r["a"], r["b"]) for r in near_dups.NearDuplicates(df, "id", ["a", "b", "c"], k=3, percent=70).pairs().collect()}
    assert got == brute(rows, 3, 70)


def test_one_hot_signature_is_enough(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(near_dups, "HOT", 4)
    monkeypatch.setattr(near_dups, "plan", lambda codes, rows, percent: ([list(range(i, i + 4)) for i in range(0, 40, 4)], [2] * 10))
    base, rows = [rng.sample(range(10**6), 30) for _ in range(4)], []
    for i in range(60):  # all agree in the first two slots and nowhere else: one shared signature, of 60 classes
        s = sorted({rng.randrange(10**6) if rng.random() < 0.08 else x for x in base[i % 4]})
        rows.append((i, len(s), np.array([1, 2, *(100 * i + j for j in range(38))], np.uint32).tobytes(), s))
    df = spark.createDataFrame(rows, "id long, n int, code binary, set array<long>")
    got = [tuple(r) for r in near_dups.candidate_pairs(df, len(rows), 70).collect()]
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if len({*a[3]} & {*b[3]}) * 100 >= len({*a[3]} | {*b[3]}) * 70}
    assert len(want) > 100 and want <= set(got) and len(got) == len(set(got))


def test_loss_is_bounded_at_every_similarity(spark):
    cost = [[1 + i, 5 + i, 11 + i, 90 + i] for i in range(10)]
    for percent in (40, 55, 70, 80, 90):
        least = next(d for d in range(40) if near_dups.missed(near_dups.allocate(cost, d + 1), percent) <= near_dups.LOSS)
        thresholds = near_dups.allocate(cost, least + 1)
        rng = np.random.default_rng(percent)
        agree = rng.random((200_000, 10, 4)) < percent / 100
        met = ((~agree).sum(2) <= np.array(thresholds)).any(1)
        assert met.mean() > 0.9999
    rows = [(i, "", "", " ".join(w)) for i, w in enumerate([["a"] * 3 + [f"x{j}" for j in range(k, k + 60)] for k in range(0, 400, 20)])]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    got = {(r["a"], r["b"]) for r in near_dups.NearDuplicates(df, "id", ["a", "b", "c"], k=3, percent=40).pairs().collect()}
    assert got == brute(rows, 3, 40) != set()


def test_correlated_slots_share_a_partition():
    both = {i * near_dups.SLOTS + i: 100.0 for i in range(near_dups.SLOTS)}
    for i, j in combinations(range(near_dups.SLOTS), 2):
        both[i * near_dups.SLOTS + j] = 90.0 if i % 10 == j % 10 else 10.0
    assert sorted(sorted(g) for g in near_dups.correlated(both)) == [[i, i + 10, i + 20, i + 30] for i in range(10)]


def test_boilerplate_gives_few_candidates(spark, monkeypatch):
    """A header that all records share makes half of every set, and no true pair: candidates must not grow with the square."""
    monkeypatch.setattr(near_dups, "HOT", 32)  # signatures of the header are hot at this size too
    found = []
    for n in (300, 900):
        rng = random.Random(n)
        header = " ".join(f"licence{i}" for i in range(102))
        rows = [(i, header, " ".join(edited(rng, b, i % 2)), None) for i, b in ((i, [f"w{i // 2}x{j}" for j in range(102)]) for i in range(n))]
        df = spark.createDataFrame(rows, "id long, a string, b string, c string")
        near = near_dups.NearDuplicates(df, "id", ["a", "b", "c"], k=3, percent=70)
        codes = near.classes.select("id", "n", "code", "set")
        found.append(near_dups.candidate_pairs(codes, n, 70).count())
        if n == 300:
            want = brute(rows, 3, 70)
            assert {(r["a"], r["b"]) for r in near.pairs().collect()} == want and len(want) == 150
    assert found[1] < 4 * found[0] + 100


def test_no_records(spark):
    df = spark.createDataFrame([(1, None)], "id long, a string")
    near = near_dups.NearDuplicates(df, "id", ["a"])
    assert near.pairs().count() == 0 and near.groups().count() == 0


def form(text, label):
    key = lambda s: "".join(c for c in s if c.isalnum()).upper().lower()
    return key(text or ""), tuple(sorted(x for x in map(key, (label or "").split(",")) if x))


def test_format_duplicates(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        text = rng.choice(["int a;", "INT  A", "(int)\ta", "x" * rng.randrange(1, 40), "Größe 5", "GRÖSSE 5", " -- ", "", None, "return " + str(rng.randrange(300)), "q" * 3000])
        rows.append((i, text, rng.choice(["A, b-1", "b1,A", "a", None, ",A"]), "clash"))
    want = defaultdict(list)
    for i, t, m, _ in rows:
        if form(t, m)[0]:
            want[form(t, m)].append(i)
    pairs = {(v[0], x) for v in want.values() for x in v[1:]}
    df = spark.createDataFrame(rows, "i long, t string, m string, copy string")
    for fit in (2000, 20):
        monkeypatch.setattr(format_dups, "FIT", fit)
        got = [(r["kept"], r["copy"]) for r in format_dups.duplicates(df, "i", "t", ["m"]).collect()]
        assert len(got) == len(pairs) and set(got) == pairs
        assert {(r["kept"], r["copies"]) for r in format_dups.collapsed(df, "i", "t", ["m"]).collect()} == {(v[0], len(v)) for v in want.values()}
        monkeypatch.setattr(format_dups, "BROADCAST_BYTES", 0)
    assert format_dups.duplicates(df.limit(0), "i", "t").count() == 0

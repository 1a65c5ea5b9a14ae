"""Encoding, packing and sentence units."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from millrace.llm import encode, pack, tokenizer
from millrace.llm.sentences import abbreviations, learn, segment, sentences, units


@pytest.fixture(scope="module")
def coder():
    return tokenizer.load()


def texts():
    rng = random.Random(6)
    shared = "".join(rng.choice(["the lock ", "был взят. ", "补丁。", "x_1(); ", "it's  ", "\n\n\t", "…", "🙂 ", "ไทย "]) for _ in range(400))
    out = [None, "", " ", "a", shared, "b" + shared, shared[57:] + "tail", shared[:900] + "middle" + shared[900:], "é" * 5000, "中文" * 3000, " " * 30000 + "x", "a" * 40000, "don't we'll I'd" * 300, "　  \x1c \x85y z" * 200]
    return out + out[4:6]


def test_ids_equal_those_of_whole_texts(spark, coder):
    rows = [(i // 2 if i else None, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc long, text string, ids string")
    got = sorted((r["doc"] if r["doc"] is not None else -1, tuple(r["ids"])) for r in encode.encoded(df, "doc", "text").collect())
    want = sorted((d if d is not None else -1, tuple(tokenizer.encode(coder, t or ""))) for d, t, _ in rows)
    assert got == want
    assert encode.encoded(df.limit(0), "doc", "text").count() == 0


def test_plain_texts_encode_as_the_library_does(coder):
    for t in texts():
        if t and len(t) < 20000:
            assert tokenizer.encode(coder, t) == coder.encode_ordinary(t)


def test_chunks_are_shared():
    body = " ".join(f"word{i} of the shared passage" for i in range(400))
    cut = []
    for t in (body, "another start " + body):
        data = np.frombuffer(t.encode(), np.uint8)
        at = encode.cuts(data, np.array([0, len(data)]))
        cut.append({t[a:b] for a, b in zip(at, at[1:], strict=False)})
    assert len(cut[0] & cut[1]) >= 0.9 * len(cut[0]) > 10


def test_fill():
    rng = random.Random(7)
    sizes = [rng.choice([rng.randrange(1, 60), rng.randrange(1, 400), rng.randrange(1, 2049), 2048, 1]) for _ in range(5000)]
    place = pack.fill(sizes, 2048)
    used = [0] * (max(place) + 1)
    for s, p in zip(sizes, place, strict=True):
        used[p] += s
    assert max(used) <= 2048 and min(used) > 0 and sum(used) > 0.97 * 2048 * len(used)
    assert pack.fill([], 5) == []


def test_packed(spark):
    rows = [(1, 5), (2, 10), (3, 25), (4, 0), (5, None), (6, -1), (1, 5), (None, 3), (7, 11)]
    got = pack.packed(spark.createDataFrame(rows, "i long, n long").withColumnRenamed("n", "size"), "i", "size", 10).collect()
    per, by = {}, {}
    for r in got:
        per[r["container"]] = per.get(r["container"], 0) + r["size"]
        by.setdefault(r["i"], []).append((r["part"], r["start"], r["size"]))
    assert max(per.values()) <= 10
    assert {k: sorted(v) for k, v in by.items()} == {1: [(0, 0, 5)] * 2, 2: [(0, 0, 10)], 3: [(0, 0, 10), (1, 10, 10), (2, 20, 5)], None: [(0, 0, 3)], 7: [(0, 0, 10), (1, 10, 1)]}


def test_containers_do_not_depend_on_the_split_of_the_input(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.randrange(1, 3000)) for i in range(2000)], "i long, size long")
    place = lambda d: {(r["i"], r["part"]): r["container"] for r in pack.packed(d, "i", "size", 2048).collect()}
    assert place(df.repartition(1)) == place(df.repartition(7))


CASES = [
    ["Dr. Orwen met Prof. Li at 9 a.m. on Mon. morning.", "It took 3.5 s.", "Then it ended, etc.", "See Fig. 3 and Sec. 4.1."],
    ["Wait... is it open?", "Yes…", "No.", "See v1.2.3 in lib/a.S for it.", "(See the log.)", "Done?!"],
    ['He said: "Stop.', 'Read it first."', 'She asked "why?" and left.', "free_it() ends early."],
    ["Der 2. Versuch lief am 3. Mai bis 17.30 Uhr.", "Das sind z. B. ca. 4 Zeilen.", "Er fragte: „Warum?“", "Ja."],
    ["Mme Orvalle a écrit : « Supprimez. »", "Faut-il le garder ?", "Oui."],
    ["¿Cuándo?", "La Sra. Díaz lo vio (v. fig. 3).", "«Quita eso», dijo."],
    ["См. стр. 5 и рис. 7.", "Это т. е. старый код!"],
    ["Η αλλαγή μπήκε.", "Χρειάζεται ακόμη;", "Ναι."],
    ["الجملة الأولى.", "هل هذا صحيح؟", "نعم."],
    ["यह पहला है।", "डॉ. तमिल आए।"],
]


@pytest.mark.parametrize("case", CASES)
def test_spaced_sentences(case):
    for glue in (" ", "\n", "  "):
        text = glue.join(case)
        assert [text[a:b] for a, b in units(text)] == case


def test_unspaced_sentences():
    for case in (["先应用补丁。", "审阅者写道：“请删除。”", "版本1.2旧！", "为什么？"], ["担当者は「消してください。」と書きました。", "はい。", "「終わり。」", "ときどき動く！"], ["It ran.", "The end came.", "Now"]):
        text = "".join(case)
        assert [text[a:b] for a, b in units(text)] == case
    thai = "ตำแหน่งที่สองลบบรรทัด เครื่องหมายเก่า5.8 ผู้ตรวจ\nเวอร์ชัน"
    assert [thai[a:b] for a, b in units(thai)] == thai.split()


def test_blocks():
    text = "# A. title\n\nOne. Two\nwraps here.\r\n\r\n- item one. And more\n- item two\n\nKey: a. b\n\n```c\nx. Y\n\nz;\n```\n\nlast"
    assert [text[a:b] for a, b in units(text)] == ["# A. title", "One.", "Two\nwraps here.", "- item one. And more", "- item two", "Key: a. b", "```c\nx. Y\n\nz;\n```", "last"]
    assert units("```\nopen\n\nstill. Open") == [(0, 21)]
    assert units(" \n\t") == []


def test_units_hold_all_visible_text():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice([". ", "? ", "。", "\n", "\n\n", '"', "„", "“", "«", "»", "Ab", "x", " 3", "...", "ไทย ", "# ", "- ", "```\n", "🙂", ";", ") ", "(", "\xa0"]) for _ in range(rng.randrange(40)))
        found = units(text)
        assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        covered = set().union(*(range(a, b) for a, b in found)) if found else set()
        assert all(c.isspace() for i, c in enumerate(text) if i not in covered)
        assert all(text[a:b] == text[a:b].strip() for a, b in found)


def test_abbreviations_are_learned_from_all_rows(spark):
    rows = [(f"The xyzq. part of {i} is old. It stays as it was. Then more.",) for i in range(60)]
    df = spark.createDataFrame(rows, "t string")
    assert abbreviations(df, "t") == {"xyzq"}
    assert [rows[0][0][a:b] for a, b in units(rows[0][0], frozenset({"xyzq"}))] == ["The xyzq. part of 0 is old.", "It stays as it was.", "Then more."]
    assert abbreviations(df.limit(10), "t") == frozenset()


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "Ab. Cd."), (1, "Ab. Cd."), (None, "é🙂. X"), (2, None), (3, ""), (4, "w " * 100_000)], "d long, t string")
    got = sorted((r["d"] or 0, r["start_pos"], r["end_pos"]) for r in sentences(df, "d", "t").collect())
    assert got == sorted([(1, 0, 3), (1, 4, 7)] * 2 + [(0, 0, 3), (0, 4, 5), (4, 0, 199_999)])
    assert sentences(df.limit(0), "d", "t").count() == 0


def test_long_white_space_and_long_words_hide_no_sentence():
    for n in (2, 250, 5000):
        text = "First one here." + " " * n + "Second one here. Third one here."
        assert [text[a:b] for a, b in units(text)] == ["First one here.", "Second one here.", "Third one here."]
    word = "x" * 3000
    text = f"{word}. Then {word} ran. Dr. {word} left."
    assert [text[a:b] for a, b in units(text)] == [f"{word}.", f"Then {word} ran.", f"Dr. {word} left."]


def test_time_grows_with_the_length_of_a_paragraph():
    for piece in ('He said "no." Then x1. Dr. A came. "Why?" ', "a.b.c.", "x. ", "。」", "ก ข "):
        took = []
        for n in (50_000, 400_000):
            text = piece * (n // len(piece))
            began = time.process_time()
            units(text)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.5, piece


def test_lattice_takes_the_path_of_fewest_words():
    assert segment("とにかくのちに", ["と", "に", "かく", "とにかく", "の", "のち", "のちに"]) == ["とにかく", "のちに"]
    assert segment("abxcd", ["ab", "cd"]) == ["ab", "x", "cd"]
    assert segment("", ["a"]) == []


def test_greek_question_marks_need_a_greek_sentence():
    case = ["Ναι.", "Χρειάζεται ακόμη;", "Call f(a; b) now.", "X = 1; y = 2; end."]
    text = " ".join(case)
    assert [text[a:b] for a, b in units(text)] == case


def test_opening_words_are_learned_from_all_rows(spark):
    rows = [("旧版です。がんばれと言った。「中身」という題だ。「終わり」が残る。",) for _ in range(60)]
    df = spark.createDataFrame(rows, "t string")
    learned = learn(df, "t")
    assert "がんばれ" in learned.openers and "と" not in learned.openers
    text = "彼は「消して。」がんばれ。"
    assert [text[a:b] for a, b in units(text)] == [text]
    assert [text[a:b] for a, b in units(text, learned)] == ["彼は「消して。」", "がんばれ。"]

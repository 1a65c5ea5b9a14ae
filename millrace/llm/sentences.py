"""Sentence boundaries across languages and scripts.

A document is cut into blocks (paragraphs, and lines that are a unit: headings, list items, labelled lines, fenced
blocks). In a paragraph every run of final marks, with the quotes and brackets that close behind it, is a node of a
lattice of terminators. Each node has readings with costs (:func:`readings`): the end of a sentence, or an abbreviation,
initial, ordinal, number, name or aside behind which the sentence goes on; and an end may close later marks with it. The
sentences are the cheapest path from the start of the paragraph to its end (:func:`bounds`).

Scripts without spaces have gaps instead: a closed quotation in Japanese or Chinese, white space in Thai. The whole runs
of characters on both sides of a gap are segmented by a lattice of dictionary words (:class:`Lattice`), and the gap is
classified by the final particle before it and the opening word behind it.

Abbreviations and opening words that the lists lack are learned from the whole corpus first (:func:`learn`). Then
documents are independent: the work is one map over the table in Arrow batches, without a shuffle of texts. It is linear
in the length of a paragraph: look-ups go by position, quotes are counted once, and no window bounds what is read.
The word lists hold function words and customary abbreviations of each language.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

# Titles, which are written with a capital, and other abbreviations after which the sentence goes on.
TITLES = set("Dr Prof Mr Mrs Ms Messrs Mme Mlle MM St Rev Gen Col Capt Lt Sgt Hon Gov Sen Rep Sr Sra Srta Dra Dña Ing Lic Hr Fr Frl Dipl Г-н Г-жа Проф Акад Κ Κα Δρ Καθ डॉ डा श्री प्रो पं".split())
GOES_ON = set(
    "e.g i.e cf viz vs approx ca circa incl excl acc resp esp bzw vgl z.b d.h u.a s.o s.u evtl ggf inkl exkl zzgl bspw sog einschl "
    "env c.-à-d p.ex aprox p.ej v.gr p.e т.е см ок напр т.н т.к ср им βλ π.χ δηλ prof dr sr sra г-н г-жа проф акад δρ".split()
)
# Abbreviations that belong to a number.
WITH_NUMBER = set("no nos nr sec secs sect fig figs eq eqs ch chap vol vols p pp par app art tab tabs abb abschn kap bd ziff abs núm num pág pag págs cap стр рис гл табл п пп т ст № σελ εικ κεφ αρ παρ".split())
# Abbreviations that may end a sentence.
EITHER = set("etc usw u.s.w a.m p.m inc ltd co corp bros jr u.s u.k e.u ph.d b.c a.d al др т.д т.п проч κ.λπ κλπ κ.ά ss".split())
DAYS = set("Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split())
# Words before an ordinal number in German.
BEFORE_ORDINAL = set("der die das dem den des am im vom zum zur beim bis ab seit ein einem einen einer jeder jedes jeden dieser diesem diesen unser unserem ihr ihrem sein seinem und bis".split())

# Japanese particles that take up a quotation, words that open a sentence and begin like one, and words within.
PARTICLES = "と って という といった との とか とも など なんて は が を に で も の へ や か から まで より だ です ね よ".split()
OPENERS_JA = "とき ところ ところが ところで とにかく とても とりあえず はい はじめに でも では ですから だから だが もし もう もっと もちろん もともと にもかかわらず のち のちに かつ かつて かなり やはり やがて やっと よって よく ねえ まず".split()
WITHIN_JA = "この その あの これ それ ここ そこ こと もの ため よう ほう とおり した して する します しました ました でした ません ない なかった いる います いた ある あります あった なる なり なった できる できます れる られる せる させる について によって による として たち まま だけ ほど など".split()
# Chinese words that take up a quotation, words that open a sentence and begin like one, and words within.
TAKES_UP_ZH = "的 地 这 一 等 说 道 并 而".split()
OPENERS_ZH = "这个 这里 这次 这样 这是 一个 一些 一次 并且 并不 而且 说明 道理 的确 等待 地方".split()
WITHIN_ZH = "我们 你们 他们 它们 那个 什么 没有 可以 需要 已经 因为 所以 如果 但是 或者 以及 然后 之后 之前 其中 这些 那些 时候 问题 现在 不是 不能 还是 只有 就是 为了 关于 对于 了 是 在 有 和 与 也 都 就 把 被 让 从 到 对 为".split()
# Thai words after which a phrase is not complete, and words that can stand before a gap.
OPEN_ENDS_TH = "และ หรือ ว่า ของ คือ เช่น เพราะ แต่ กับ ใน ที่ ซึ่ง".split()
WITHIN_TH = "ไว้ แล้ว เดิม ออก ครั้ง อีก ครับ ค่ะ คะ นะ เลย ด้วย มาก ที่นี่ ในที่ ทันที ต่างๆ ไม่ ได้ มี เป็น จะ ให้ ต้อง การ ความ นี้ นั้น กัน ไป มา อยู่ จาก โดย ตาม ก่อน หลัง เมื่อ ถ้า จึง ก็ ยัง ทำ ใช้ เรา คุณ เขา มัน ทั้ง ทุก บาง หลาย อื่น ใหม่ เก่า แรก สุดท้าย บรรทัด ข้อความ".split()

#: A learned word must hold at least this share of all places that could teach one, so at most 1 / share words of a kind
#: are learned, at any size of the corpus; and it must go on in this share of its places by the lower bound of the score
#: interval with this many deviations.
LEARNED_PLACES, LEARNED_SHARE, DEVIATIONS = 1e-5, 0.8, 1.96
#: How much more often a learned opening word stands behind a sentence than behind an open quotation's end.
OPENS_TIMES = 20

FINAL = "!?‽…！？。｡．؟।॥."
WIDE_FINAL = frozenset("！？。｡．؟।॥")
MARKS = re.compile(r"[!?‽…！？。｡．؟।॥.;;]+")
QUESTION = frozenset(";;")
CLOSERS = frozenset(")]}）］」』】》〉›”’")
BRACKETS = frozenset(")]}）］")
BEFORE_MARK = CLOSERS | frozenset('"»“')
GOES_BEHIND = frozenset(",;:，、；：)]}»–—-/%*=&")
OPENING_QUOTES = frozenset("“«„¿¡「『《")
THAI = regex.compile(r"\p{Thai}")
GREEK = regex.compile(r"\p{Greek}")
EMOJI = r"[\p{So}\p{Extended_Pictographic}️‍\p{Emoji_Modifier}]"
EMOJI_THEN_MARK = regex.compile(rf"\s*(?:{EMOJI})++\s*[{re.escape(FINAL)}]")
CODE_LIKE = regex.compile(r"\p{Ll}[\w.\-]*(?:[_/(]|\[)|\p{Ll}+\d+[\w.]*\(")
NAME_RUN = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{N}_]{1,5}")
PARTS_WORD = re.compile(r"[\s(\[{“„«\"「『‘<（，。、：=]")
SPACELESS = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー々]+")
VISIBLE = re.compile(r"\S")
LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|$)")
FENCE = re.compile(r"\s*(```+|~~~+)")
UNIT_LINE = re.compile(r"\s*(?:#{1,6}(?:\s|$)|[-*+•‣◦]\s|\(?\d{1,3}[.)]\s|\S+:(?:\s|$))")
HEADING = re.compile(r"#{1,6}\s")
THAI_GAP = re.compile(r"(\S+)(\s+)(?=(\S+))")
DASHES = "—–-…"

LISTED = max(len(w) for w in TITLES | GOES_ON | WITH_NUMBER | EITHER | DAYS) + 6
ORDINAL_WORD = max(map(len, BEFORE_ORDINAL))
#: Costs of readings: one whose context holds, one that is possible, one that its context speaks against, none at all.
HOLDS, POSSIBLE, AGAINST, NEVER = 0.0, 1.0, 4.0, 1e9


class Lattice:
    """A lattice of dictionary words over a run of characters; a word costs 2, a character in no word 5."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = ahocorasick.Automaton()
        for w in set(words):
            self.words.add_word(w, len(w))
        self.words.make_automaton()

    def segment(self, run: str) -> list[str]:
        """The words on the cheapest path through the whole run; among equals the last word is the longest."""
        at: dict[int, list[int]] = {}
        for last, n in self.words.iter(run):
            at.setdefault(last + 1, []).append(n)
        cost, start = [0] * (len(run) + 1), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            best, begin = cost[end - 1] + 5, end - 1
            for n in sorted(at.get(end, ())):
                if cost[end - n] + 2 <= best:
                    best, begin = cost[end - n] + 2, end - n
            cost[end], start[end] = best, begin
        out, end = [], len(run)
        while end:
            out.append(run[start[end] : end])
            end = start[end]
        return out[::-1]


@dataclass(frozen=True)
class Learned:
    """Words learned from a corpus: abbreviations behind which sentences go on, and words that open sentences."""

    abbreviations: frozenset[str] = frozenset()
    openers: frozenset[str] = frozenset()


class Dictionaries:
    """The lists and what was learned, as lattices of words."""

    def __init__(self, learned: Learned) -> None:
        self.goes_on = frozenset(GOES_ON | (learned.abbreviations - EITHER - WITH_NUMBER))
        self.listed = max([LISTED, *map(len, learned.abbreviations)])
        kana = [w for w in learned.openers if "぀" <= w[0] <= "ゟ"]
        han = [w for w in learned.openers if not "぀" <= w[0] <= "ゟ"]
        self.japanese = Lattice([*PARTICLES, *OPENERS_JA, *WITHIN_JA, *kana])
        self.chinese = Lattice([*TAKES_UP_ZH, *OPENERS_ZH, *WITHIN_ZH, *han])
        self.thai = Lattice([*OPEN_ENDS_TH, *WITHIN_TH])


@lru_cache(maxsize=4)
def dictionaries(learned: Learned) -> Dictionaries:
    return Dictionaries(learned)


def segment(text: str, words: list[str]) -> list[str]:
    """The cheapest path through the lattice of known words; a character that is in no word stands alone at a cost."""
    return Lattice(words).segment(text)


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is one unit) of each block in order."""
    start, fence, fence_at = None, None, 0
    for m in LINE.finditer(text):
        line = m.group(1)
        if fence:
            if line.strip().startswith(fence):
                yield fence_at, m.end(1), True
                fence = None
            continue
        mark = FENCE.match(line)
        unit = mark or UNIT_LINE.match(line) if start is None else mark or HEADING.match(line)
        if start is not None and (unit or not line.strip()):
            yield start, m.start(), False
            start = None
        if mark:
            fence, fence_at = mark.group(1), m.start()
        elif unit:
            yield m.start(), m.end(1), True
        elif start is None and line.strip():
            start = m.start()
    if fence:
        yield fence_at, len(text), True
    if start is not None:
        yield start, len(text), False


class Paragraph:
    """A paragraph with the places of its quotes, found once, and the start of the word before the present mark."""

    def __init__(self, p: str, words: Dictionaries) -> None:
        self.p, self.n, self.words = p, len(p), words
        self.at = {c: [m.start() for m in re.finditer(c, p)] if c in p else [] for c in '"„“«»'}
        self.greek = [m.start() for m in GREEK.finditer(p)] if ";" in p or ";" in p else []
        self.seen = self.word_at = 0

    def count(self, c: str, end: int) -> int:
        return bisect_left(self.at[c], end)

    def last(self, c: str, end: int) -> int:
        k = self.count(c, end)
        return self.at[c][k - 1] if k else -1

    def visible(self, k: int) -> int:
        """The place of the first visible character from ``k`` on."""
        m = VISIBLE.search(self.p, k)
        return m.start() if m else self.n

    def word_start(self, i: int) -> int:
        """Where the word that ends at ``i`` starts; ``i`` never falls from call to call, so each place is read once."""
        for m in PARTS_WORD.finditer(self.p, self.seen, i):
            self.word_at = m.end()
        self.seen = max(self.seen, i)
        return min(self.word_at, i)

    def closing(self, k: int) -> tuple[int, bool]:
        """The end of the quotes and brackets that close at ``k``, with the marks between them, and whether one is a quote."""
        p, quote = self.p, False
        while k < self.n:
            c = p[k]
            if c in CLOSERS and not (c == "’" and p[k + 1 : k + 2].isalpha()):
                quote |= c not in BRACKETS
            elif c == '"' and self.count('"', k) % 2:
                quote = True
            elif c == "“" and self.last("„", k) > self.last("“", k):
                quote = True
            elif c == "'" and (k + 1 == self.n or p[k + 1].isspace()):
                quote = True
            elif c == "»":
                quote = True
            elif c.isspace() and self.at["«"] and self.count("«", k) > self.count("»", k) and p[(v := self.visible(k)) : v + 1] == "»":
                k, quote = v, True
            elif not (c in FINAL and k and p[k - 1] in BEFORE_MARK):
                break
            k += 1
        return k, quote

    def word_before(self, b: int) -> str:
        """The word before the one that starts at ``b`` in small letters and without quotes, or "" if it is in no list."""
        p, e = self.p, b
        while e and p[e - 1].isspace():
            e -= 1
        while e and p[e - 1] in "„“«(":
            e -= 1
        a = e
        while a and e - a <= ORDINAL_WORD and not p[a - 1].isspace() and p[a - 1] not in "„“«(":
            a -= 1
        return p[a:e].lower()


def readings(par: Paragraph, i: int, j: int) -> tuple[int, float, float]:
    """(end, cost of ending there, cost of going on) of the marks p[i:j]."""
    p = par.p
    word_at = par.word_start(i)
    marks = p[i:j].strip(";;")
    k, quote = (j, False) if p[j : j + 1] == " " and not par.at["«"] else par.closing(j)
    v = k + 1 if p[k : k + 1] == " " and p[k + 1 : k + 2] > " " else par.visible(k)
    if v == par.n or p[v].isspace() and (v := par.visible(v)) == par.n:
        return k, HOLDS, NEVER
    closed, space, nxt = k > j, v > k, p[v]
    if nxt in GOES_BEHIND or not nxt.isalnum() and EMOJI_THEN_MARK.match(p, k):
        return k, AGAINST, HOLDS
    if marks[-1] in WIDE_FINAL:
        return (k, AGAINST, HOLDS) if quote and not space and taken_up(par, v) else (k, HOLDS, AGAINST)
    if not space and not closed:
        return (k, HOLDS, AGAINST) if parts_unspaced(p, word_at, i, v, marks) else (k, AGAINST, HOLDS)
    lower = nxt.islower() and not CODE_LIKE.match(p, v)
    if lower and nxt.isalpha():
        return k, AGAINST, HOLDS
    if marks == "." and not closed:
        return k, *full_stop(par, word_at, i, nxt, lower)
    return k, HOLDS, AGAINST


def full_stop(par: Paragraph, b: int, i: int, nxt: str, lower: bool) -> tuple[float, float]:
    """(cost of ending, cost of going on) of a full stop at ``i`` with a space behind it and the word from ``b`` before."""
    p = par.p
    if i - b > par.words.listed:
        return HOLDS, AGAINST
    word = p[b:i]
    low = word.lower().lstrip(DASHES)
    if len(word) == 1 and word.isalpha() and (word.isupper() or word.islower()):
        # an initial or an abbreviation, but a letter behind a number is a unit
        while b and p[b - 1].isspace():
            b -= 1
        return (HOLDS, POSSIBLE) if word.islower() and b and p[b - 1].isdigit() and not lower else (POSSIBLE, HOLDS)
    if word in TITLES or low in par.words.goes_on:
        return AGAINST, HOLDS
    if low in WITH_NUMBER and (nxt.isdigit() or nxt in "№#"):
        return AGAINST, HOLDS
    if low in EITHER:
        return (AGAINST, HOLDS) if lower else (HOLDS, POSSIBLE)
    if word in DAYS:
        return (AGAINST, HOLDS) if nxt.isdigit() or lower else (HOLDS, POSSIBLE)
    if word.isdigit() and len(word) <= 2 and nxt.isalpha() and par.word_before(b) in BEFORE_ORDINAL:
        return POSSIBLE, HOLDS
    return HOLDS, AGAINST


def taken_up(par: Paragraph, v: int) -> bool:
    """A closed quotation is taken up by the same sentence: the word behind it is a particle, not an opening word."""
    m = SPACELESS.match(par.p, v)
    if not m:
        return False
    if "぀" <= par.p[v] <= "ゟ":
        return par.words.japanese.segment(m[0])[0] in PARTICLES
    return par.words.chinese.segment(m[0])[0] in TAKES_UP_ZH


def parts_unspaced(p: str, b: int, i: int, v: int, marks: str) -> bool:
    """Marks with no space behind them still end a sentence before a word that can open one; the word p[b:i] is before them."""
    nxt = p[v]
    if nxt in OPENING_QUOTES:
        return True
    if not nxt.isalpha() or nxt.islower():
        return False
    if not nxt.isupper():
        return i > b
    run = NAME_RUN.match(p, v)
    name = run and len(run[0]) <= 4 and run[0].isupper() and run[0] not in ("I", "A")
    return not (marks == "." and (name or i - b == 0 or i - b == 1 and p[b].isalpha()))


def bounds(par: Paragraph) -> list[int]:
    """The ends of sentences: the cheapest path through the lattice of terminators.

    Two paths are carried on while they are close, the best that ends a sentence at the last node and the best that goes
    on there. A node that lies within what the last end of a path has closed is passed by that path.
    """
    paths: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)]
    for m in MARKS.finditer(par.p):
        i, j = m.span()
        if all(i < last for _, last, _ in paths):
            continue
        question = QUESTION.issuperset(m[0])
        k, end, on = (j, NEVER, HOLDS) if question else readings(par, i, j)
        ends, goes = [], []
        for path in paths:
            cost, last, chain = path
            if i < last:
                goes.append(path)
                continue
            if question and bisect_left(par.greek, i) - bisect_left(par.greek, last) >= 3 and (j == par.n or par.p[j].isspace()):
                # a semicolon asks in a Greek sentence
                ends.append((cost + HOLDS, j, (j, chain)))
                goes.append((cost + AGAINST, last, chain))
            else:
                ends.append((cost + end, k, (k, chain)))
                goes.append((cost + on, last, chain))
        paths = [min(x, key=lambda path: path[0]) for x in (ends, goes) if x]
        if len(paths) > 1 and abs(paths[0][0] - paths[1][0]) >= AGAINST:
            paths = [min(paths, key=lambda path: path[0])]
    chain, out = min(paths, key=lambda path: path[0])[2], []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def gaps(p: str, start: int, end: int, words: Dictionaries) -> Iterator[int]:
    """Positions of white space in p[start:end] that parts Thai text."""
    for m in THAI_GAP.finditer(p, start, end):
        left, right = m[1], m[3]
        if not (THAI.search(left) and THAI.search(right)) or right[0] in "ๆฯ":
            continue
        if words.thai.segment(left)[-1] not in OPEN_ENDS_TH:
            yield m.start(2)


def units(text: str, learned: frozenset[str] | Learned = Learned()) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a document, in code points, without surrounding white space."""
    words = dictionaries(learned if isinstance(learned, Learned) else Learned(learned))
    found: list[tuple[int, int]] = []

    def keep(a: int, b: int) -> None:
        piece = text[a:b]
        bare = piece.strip()
        if bare:
            a += len(piece) - len(piece.lstrip())
            found.append((a, a + len(bare)))

    for a, b, one in blocks(text):
        if one:
            keep(a, b)
            continue
        p = text[a:b]
        thai = THAI.search(p)
        begin = 0
        for end in [*bounds(Paragraph(p, words)), len(p)]:
            for gap in gaps(p, begin, end, words) if thai else ():
                keep(a + begin, a + gap)
                begin = gap
            keep(a + begin, a + end)
            begin = end
    return found


def learn(df: DataFrame, text: str) -> Learned:
    """What the corpus teaches, counted over all rows.

    * Abbreviations: words of a script with letter case whose full stop is followed by a plain word in small letters in at
      least ``LEARNED_SHARE`` of their places, by the lower bound of the score interval.
    * Opening words of Japanese and Chinese that begin like a particle: ``OPENS_TIMES`` more frequent behind sentences than
      behind quotations that hold no final mark, which the same sentence takes up.

    A word of fewer than ``LEARNED_PLACES`` of all places of its kind is not learned, so what comes to the driver is
    bounded whatever the size of the corpus.
    """
    firsts = "".join(sorted({w[0] for w in PARTICLES}))
    firsts_zh = "".join(TAKES_UP_ZH)
    word = rf"([{firsts}][ぁ-ゖ]{{1,5}}|[{firsts_zh}][一-龥])"
    extract = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    place = lambda kind, w, on: F.struct(F.lit(kind).alias("kind"), w.alias("w"), on.alias("on"))
    stops = F.transform(extract(r"(?<![\p{L}\p{N}./_\-])\p{L}[\p{L}.]{0,8}\.[ \n]+\S+", 0), lambda x: place("abbreviation", F.lower(F.regexp_extract(x, r"^([\p{L}.]+)\.\s", 1)), F.regexp_extract(x, r"\s(\S+)$", 1).rlike(r"^\p{Ll}\p{L}*[,;:.!?]?$")))
    wide = F.col(text).rlike("[。！？]")
    opens = F.when(wide, F.transform(extract(rf"[。！？]{word}", 1), lambda x: place("opener", x, F.lit(True)))).otherwise(F.array())
    taken = F.when(wide, F.transform(extract(rf"[^。！？」』”\s][」』”]{word}", 1), lambda x: place("opener", x, F.lit(False)))).otherwise(F.array())
    seen = df.select(F.explode(F.concat(stops, opens, taken)).alias("x")).select("x.*")
    # a run of kana counts for each of its beginnings
    begins = F.when(F.col("kind") == "opener", F.transform(F.sequence(F.lit(2), F.greatest(F.length("w"), F.lit(2))), lambda n: F.substr("w", F.lit(1), n))).otherwise(F.array("w"))
    counts = materialize(seen.select("kind", "on", F.explode(begins).alias("w")).groupBy("kind", "w").agg(F.count("*").alias("n"), F.count_if("on").alias("on")), "learned")
    total = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("on").alias("on")).collect()}
    n, on = F.col("n"), F.col("on")
    of = lambda kind, field: total[kind][field] if kind in total else 0
    z = DEVIATIONS**2
    score = (on + z / 2 - DEVIATIONS * F.sqrt(on * (n - on) / n + z / 4)) / (n + z)
    cased = F.col("w").rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}.]+$")
    short = counts.where((F.col("kind") == "abbreviation") & cased & (n >= LEARNED_PLACES * of("abbreviation", "n")) & (score >= LEARNED_SHARE))
    often = on * (of("opener", "n") - of("opener", "on") + 1) >= OPENS_TIMES * (n - on + 1) * of("opener", "on")
    first = counts.where((F.col("kind") == "opener") & (n >= LEARNED_PLACES * of("opener", "n")) & often & ~F.col("w").isin(PARTICLES))
    words = short.unionByName(first).select("kind", "w").collect()
    return Learned(*(frozenset(r["w"] for r in words if r["kind"] == kind) for kind in ("abbreviation", "opener")))


def abbreviations(df: DataFrame, text: str) -> frozenset[str]:
    """The abbreviations of :func:`learn`."""
    return learn(df, text).abbreviations


def _units(learned: Learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, stop = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b in units(text, learned):
                    row.append(i)
                    starts.append(a)
                    stop.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(starts, pa.int64()), pa.array(stop, pa.int64())], ["i", "s", "e"])

    return run


def sentences(df: DataFrame, item: str, text: str) -> DataFrame:
    """(``item``, ``start_pos``, ``end_pos``): the sentence units of every row's text, end exclusive.

    Null, empty and blank texts have none. Every row is split by itself, repeated rows and null items too. Other columns
    are not read. An empty table gives no rows.
    """
    slim = df.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col("t") != "")
    kind = dict(slim.dtypes)["i"]
    out = slim.mapInArrow(_units(learn(slim, "t")), f"i {kind}, s long, e long")
    return out.select(F.col("i").alias(item), F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))

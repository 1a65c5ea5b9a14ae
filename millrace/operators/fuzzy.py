"""Fuzzy location inside a record: normalised edit distance, best windows, and the best pair of bounds.

All candidates of one record are elements of its arrays, so the search is a map without a join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


#: Bounds up to which the nearest window is looked for before the whole bound.
STEPS = (0.1, 0.3)


def distance(a: Column, b: Column) -> Column:
    """Edit distance divided by the greater length; 0 for two empty texts."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def any_close(left: Column, right: Column, most: float) -> Column:
    """Some element of ``left`` and some non-blank element of ``right`` are within ``most``; blank elements never are."""
    full = lambda x: F.filter(x, lambda y: y.rlike(r"\S"))
    close = lambda a, b: (F.abs(F.length(a) - F.length(b)) <= most * F.greatest(F.length(a), F.length(b))) & (distance(a, b) <= most)
    return F.exists(full(left), lambda a: F.exists(full(right), lambda b: close(a, b)))


def best_window(lines: Column, wanted: Column) -> Column:
    """(distance, position) of the element nearest to ``wanted``; the first of equals. Null for no elements."""
    return F.array_min(F.transform(lines, lambda x, i: F.struct(distance(x, wanted).alias("distance"), i.cast("long").alias("position"))))


def best_pair(lines: Column, head: Column, tail: Column) -> Column:
    """(sum, head position, tail position) of least sum with head <= tail; the first head, then the first tail of equals.

    For every tail position only the best head up to it matters, so the pairs are scanned in one fold.
    """
    scored = F.transform(lines, lambda x, i: F.struct(distance(x, head).alias("h"), distance(x, tail).alias("t"), i.cast("long").alias("i")))
    none = F.lit(None)
    start = F.struct(none.cast("struct<d:double,i:long>").alias("head"), none.cast("struct<sum:double,head:long,tail:long>").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        mine = F.struct(x["h"].alias("d"), x["i"].alias("i"))
        head_now = F.when(acc["head"].isNull() | (mine["d"] < acc["head"]["d"]), mine).otherwise(acc["head"])
        pair = F.struct((head_now["d"] + x["t"]).alias("sum"), head_now["i"].alias("head"), x["i"].alias("tail"))
        return F.struct(head_now.alias("head"), F.when(acc["best"].isNull() | (pair < acc["best"]), pair).otherwise(acc["best"]).alias("best"))

    return F.aggregate(scored, start, step)["best"]


def located_range(rows: DataFrame, item: str, lines: str, head: str, tail: str, most: float) -> DataFrame:
    """(item, ``first``, ``last``): the range between the lines nearest to ``head`` and to ``tail``.

    Both are searched independently; if they cross, the best pair in order is taken. Null if one of the distances is
    above ``most``, and for no elements. The searches are a projection of their own, so each runs once a row.
    """
    found = rows.select(item, best_window(F.col(lines), F.col(head)).alias("a"), best_window(F.col(lines), F.col(tail)).alias("b"), best_pair(F.col(lines), F.col(head), F.col(tail)).alias("pair"))
    near = (F.col("a.distance") <= most) & (F.col("b.distance") <= most)
    free = F.col("a.position") <= F.col("b.position")
    return found.select(item, F.when(near, F.when(free, F.col("a.position")).otherwise(F.col("pair.head"))).alias("first"), F.when(near, F.when(free, F.col("b.position")).otherwise(F.col("pair.tail"))).alias("last"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: an expression inside a higher-order function is else computed for every
    element and every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(lines: Column, context: Column, anchored: bool, tail: bool) -> tuple[Column, Column]:
    """The texts of the windows by start, and the context's text."""
    ls, c = (F.reverse(lines), F.reverse(context)) if tail else (lines, context)
    n = F.size(c)
    starts = F.when((n > 0) & (F.size(ls) >= n), F.sequence(F.lit(0), F.size(ls) - n)).otherwise(F.array().cast("array<int>"))
    windows = bound(ls, lambda xs: F.transform(starts, lambda i: F.array_join(F.slice(xs, i + 1, F.size(xs) - i if anchored else n), "")))
    return windows, F.array_join(c, "")


def _scores(windows: Column, wanted: Column, most: float | Column) -> Column:
    def score(x: Column, w: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(w), F.lit(1))
        # the bounded distance is -1 beyond its bound
        bounded = F.call_function("levenshtein", x, w, F.floor(F.lit(most) * longest + 1e-9).cast("int"))
        far = F.abs(F.length(x) - F.length(w)) > F.lit(most) * longest
        near = bound(bounded, lambda d: F.when(d < 0, F.lit(float("inf"))).otherwise(d / longest))
        return F.when(x == w, F.lit(0.0)).when(far, F.lit(float("inf"))).otherwise(near)

    return bound(wanted, lambda w: F.transform(windows, lambda x: score(x, w)))


def window_scores(lines: Column, context: Column, most: float | Column = 1.0, anchored: bool = False, tail: bool = False) -> Column:
    """The distance of ``context`` to each window of as many elements, by start; anchored windows reach to the last element.

    Windows above ``most`` count as infinitely far; their distance is followed no further than that.

    For a tail both are taken in reverse order, so windows are numbered from the end and anchored ones reach to the first
    element. No element for an empty context, or one longer than the lines.
    """
    return _scores(*_windows(lines, context, anchored, tail), most)


def suffix_distances(text: str, wanted: str, longest: int) -> list[int]:
    """The edit distance of ``wanted`` to the last j characters of ``text``, for j = 0 to ``longest``.

    The columns of the distance table are taken from the end of the text on, each as two sets of bits for its steps up and
    down (bit-parallel), so a column costs a few operations on whole numbers.
    """
    m = len(wanted)
    every, top = (1 << m) - 1, 1 << m >> 1
    at: dict[str, int] = {}
    for i, x in enumerate(reversed(wanted)):
        at[x] = at.get(x, 0) | 1 << i
    up, down, score, out = every, 0, m, [m]
    for x in reversed(text[max(0, len(text) - longest) :]):
        eq = at.get(x, 0)
        right = (((eq & up) + up) ^ up) | eq
        more, less = down | (every & ~(right | up)), up & right
        score += bool(more & top) - bool(less & top) if m else 1
        more, less = (more << 1 | 1) & every, less << 1 & every
        vertical = eq | down
        up, down = less | (every & ~(vertical | more)), more & vertical
        out.append(score)
    return out


def _first_nearest(lines: list[str] | None, context: list[str] | None, most: float) -> int | None:
    if not lines or not context or len(lines) < len(context):
        return None
    wanted, text = "".join(context), "".join(lines)
    # beyond this length the difference in length alone is above the bound
    far = int(len(wanted) / (1 - most)) + 1 if most < 1 else len(text)
    distances = suffix_distances(text, wanted, far)
    best, left = None, len(text)
    for i in range(len(lines) - len(context) + 1):
        if left < len(distances):
            score = distances[left] / max(left, len(wanted), 1)
            if score <= most and (best is None or score < best[0]):
                best = (score, i)
        left -= len(lines[i])
    return best[1] if best else None


@F.arrow_udf(IntegerType())
def _nearest_suffix(lines: pa.Array, context: pa.Array, most: pa.Array) -> pa.Array:
    """The first start of the end of ``lines`` that is nearest to ``context``, within ``most``."""
    return pa.array([_first_nearest(*row) for row in zip(lines.to_pylist(), context.to_pylist(), most.to_pylist(), strict=True)], pa.int32())


def nearest_window(lines: Column, context: Column, most: float | Column = 1.0, anchored: bool = False, tail: bool = False) -> Column:
    """The first start of the least score of :func:`window_scores` that is at most ``most``; null if there is none.

    The first window that equals the context is nearest. Else distances are followed up to ``STEPS`` one after the other: the
    least one within a step is the least of all, and the cost of a distance grows with its bound. Anchored windows are ends of
    one text, so one pass over it gives the distances of all (:func:`suffix_distances`).
    """
    if anchored:
        ls, c = (F.reverse(lines), F.reverse(context)) if tail else (lines, context)
        return _nearest_suffix(ls, c, F.lit(most).cast("double")).cast("long")
    windows, wanted = _windows(lines, context, False, tail)

    def search(ws: Column) -> Column:
        equal = F.array_position(ws, wanted)
        found = [bound(_scores(ws, wanted, F.least(F.lit(step), F.lit(most)) if step else most), lambda scores: best_start(scores, most)) for step in (*STEPS, None)]
        return F.when(equal > 0, equal - 1).otherwise(F.coalesce(*found))

    return bound(windows, search)


def best_start(scores: Column, most: float | Column) -> Column:
    """The first position of the least score that is at most ``most``; null if there is none."""
    return F.when(F.array_min(scores) <= most, F.array_position(scores, F.array_min(scores)) - 1)


def bounded_pair(heads: Column, tails: Column, n: Column, least: Column, longest: Column, most: float | Column) -> Column:
    """(sum, head, tail) of least sum of a head and a tail score, both at most ``most``, with least <= gap <= longest.

    A head is the end of its window of ``n`` elements, a tail the start of its window; the first head, then the first
    tail of equals. Only scores within ``most`` are paired.
    """
    placed = lambda scores, off: F.filter(F.transform(scores, lambda x, i: F.struct(x.alias("d"), (i + off).cast("long").alias("at"))), lambda v: v["d"] <= most)
    fits = lambda a, starts: F.filter(starts, lambda b: (b["at"] >= a["at"] + least) & (b["at"] <= a["at"] + longest))
    pairs = lambda starts: F.transform(placed(heads, n), lambda a: F.transform(fits(a, starts), lambda b: F.struct((a["d"] + b["d"]).alias("sum"), a["at"].alias("head"), b["at"].alias("tail"))))
    return F.array_min(F.flatten(bound(placed(tails, F.lit(0)), pairs)))


def context_range(rows: DataFrame, item: str, most: float | Column, factor: int = 100) -> DataFrame:
    """(item, ``first``, ``last``): the range of ``lines`` between the windows nearest to the lines of ``head`` and ``tail``.

    Both are searched independently, the head's first and the tail's last of equals. If they cross, the pair of least sum
    is taken whose gap is at least the lesser number of lines in ``base`` and ``remote`` divided by ``factor`` and at most
    the greater times ``factor``. Null if a context is empty or not found, or if no pair fits.
    """
    sizes = F.size("base").cast("long"), F.size("remote").cast("long")
    n, m, size = F.size("head"), F.size("tail"), F.size("lines")
    ends = rows.where(F.greatest(*sizes) > 0).select(
        item, "lines", "head", "tail", F.floor(F.least(*sizes) / factor).alias("least"), (F.greatest(*sizes) * factor).alias("longest"), F.lit(most).alias("most"),
        (nearest_window(F.col("lines"), F.col("head"), most) + n).alias("a"), (size - nearest_window(F.col("lines"), F.col("tail"), most, tail=True) - m).alias("b"),
    )
    # all distances are needed only where the two searches cross
    scores = lambda c, tail: window_scores(F.col("lines"), F.col(c), F.col("most"), tail=tail)
    crossed = F.when(F.col("a") > F.col("b"), bounded_pair(scores("head", False), F.reverse(scores("tail", True)), n, F.col("least"), F.col("longest"), F.col("most")))
    paired = ends.select(item, "a", "b", crossed.alias("pair"))
    return paired.select(item, F.when(F.col("a") <= F.col("b"), F.col("a")).otherwise(F.col("pair.head")).alias("first"), F.when(F.col("a") <= F.col("b"), F.col("b")).otherwise(F.col("pair.tail")).alias("last"))


def relocated(rows: DataFrame, item: str, group: str, caps: tuple[float, float] = (0.75, 0.9), side_caps: tuple[float, float] = (0.1, 0.05), reach: int = 100) -> DataFrame:
    """(group, ``first``, ``last``, ``found``, ``pieces``): where the pieces of a group belong in their ``lines``, as one hull.

    Each piece (``lines``, ``head``, ``tail``, ``base``, ``remote`` and the column ``group``) is located by its context
    (:func:`context_range`), within the second of ``caps`` if it replaces no lines and the first otherwise. The range is then
    extended, never narrowed: to the ends of the anchored windows of both contexts, and to the end of the base lines, or
    else the remote lines, if that lies at most ``reach`` lines behind it. ``found`` counts the located pieces; without
    any the hull is null.
    """
    most = F.when(F.size("base") == 0, caps[1]).otherwise(caps[0])
    ranged = context_range(rows, item, most)
    at = lambda c, cap, **kw: nearest_window(F.col("lines"), F.col(c), cap, **kw)
    ends = rows.select(
        item, group, (at("head", most, anchored=True) + F.size("head")).alias("out_first"), (F.size("lines") - at("tail", most, anchored=True, tail=True) - F.size("tail")).alias("out_last"),
        F.coalesce(at("base", side_caps[0]) + F.size("base"), at("remote", side_caps[1]) + F.size("remote")).alias("side_end"),
    )
    met = ends.join(ranged, item, "left")
    last = F.greatest("last", "out_last")
    wide = met.select(group, F.when(F.col("first").isNotNull(), F.least("first", "out_first")).alias("first"), F.when(F.col("last").isNotNull(), last).alias("last"), "side_end")
    wide = wide.withColumn("last", F.when(F.col("last").isNotNull() & (F.col("side_end") > F.col("last")) & (F.col("side_end") <= F.col("last") + reach), F.col("side_end")).otherwise(F.col("last")))
    return wide.groupBy(group).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count_if(F.col("first").isNotNull() & F.col("last").isNotNull()).alias("found"), F.count("*").alias("pieces"))

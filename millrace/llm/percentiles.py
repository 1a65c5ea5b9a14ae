"""Percentiles of very large numeric columns by exact bisection, mergeable over a part column such as the day.

For every group and percentile an interval of values is kept that holds the value of the target rank. A pass halves
every open interval several times at once: it counts the rows below each midpoint, takes the piece that holds the target
rank, and shrinks it to the least and greatest value that occur there. The interval is resolved when both are equal, so the
result is the exact value of the rank and not an estimate. An interval is halved ``FEWEST_HALVINGS`` to ``HALVINGS`` times,
so often that a large one has some rows for each piece; midpoints lie on a logarithmic scale, as tails are long.

Counts are taken per part (day) first and then added up over the parts: the percentiles over all days come from what
the single days yielded, for the same midpoints. What passes between tasks is one row per group, interval and piece.

The rows are merged by identifier and written once as (group, part, column, value), and every pass is one scan, which
counts the intervals of a value's own part and those over all parts. Whenever the open intervals hold half of the rows
or fewer, only those rows are written again for the passes that follow; after the first pass that is a small part. The
intervals are joined by broadcast while their table is below ``BROADCAST_BYTES`` (checked, not assumed), else by a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

HALVINGS, FEWEST_HALVINGS = 10, 6
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 160


def _scale(v: Column) -> Column:
    """A growing function of ``v`` on which long tails are short."""
    return F.signum(v) * F.log1p(F.abs(v))


def _pieces(rows: Column) -> Column:
    """Into how many pieces an interval of so many rows is cut: a power of two."""
    return F.pow(F.lit(2.0), F.least(F.greatest(F.floor(F.log2(rows.cast("double"))) - 2, F.lit(FEWEST_HALVINGS)), F.lit(HALVINGS)))


def _piece(v: Column, lo: Column, hi: Column, pieces: Column) -> Column:
    """Which of ``pieces`` parts of [lo, hi] holds ``v``; infinities have the outermost parts to themselves."""
    infinite = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    apart = _scale(hi) > _scale(lo)
    share = F.when(apart, (_scale(v) - _scale(lo)) / (_scale(hi) - _scale(lo))).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    within = F.when(hi == lo, 0).otherwise(F.greatest(F.least(F.floor(share * pieces), pieces - 1), F.lit(0))).cast("int")
    by_sign = F.when(v == float("-inf"), 0).when(v == float("inf"), pieces - 1).otherwise(pieces / 2).cast("int")
    return F.when(infinite & (pieces > 2), by_sign).when(infinite, F.when(v == lo, 0).otherwise(1)).otherwise(within)


def _same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    on = F.lit(True)
    for a, b in pairs:
        on = on & a.eqNullSafe(b)
    return on


def percentiles(df: DataFrame, group: str, part: str, columns: Sequence[str], percents: Sequence[int], item: str | None = None) -> DataFrame:
    """(``group``, ``part``, ``scope``, ``measure``, ``percent``, ``n``, ``value``).

    ``scope`` is ``part`` for a group's rows of one part and ``all`` (with a null part) for all its parts. ``value`` is
    the value of rank ceil(percent / 100 * n) in ascending order among the ``n`` values that are neither null nor NaN;
    a group without such values has no row. Rows with the same ``item`` count once, by the row that is least in
    (group, part, columns); null items are all kept. Null groups and parts are groups and parts of their own. Other
    columns are not read. An empty table gives no rows.
    """
    rows = df.select(F.struct(F.col(group).alias("g"), F.col(part).alias("p"), *(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns))).alias("row"), *([F.col(item).alias("i")] if item else []))
    if item:
        rows = rows.where(F.col("i").isNotNull()).groupBy("i").agg(F.min("row").alias("row")).select("row").union(rows.where(F.col("i").isNull()).select("row"))
    cells = F.array(*(F.struct(F.lit(k).alias("m"), (F.col(f"row.c{k}") + 0.0).alias("v")) for k in range(len(columns))))
    long = rows.select(F.col("row.g").alias("g"), F.col("row.p").alias("p"), F.inline(cells)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    long = materialize(long, "values")

    yields = materialize(long.groupBy("g", "p", "m").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "yields")
    whole = yields.groupBy("g", "m").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("g", F.lit(None).cast(yields.schema["p"].dataType).alias("p"), "m", "n", "lo", "hi")
    targets = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.ceil(F.lit(q) * F.col("n") / 100).cast("long").alias("k")) for q in percents)))
    scoped = yields.select("g", "p", F.lit(False).alias("all"), "m", "n", "lo", "hi").unionByName(whole.select("g", "p", F.lit(True).alias("all"), "m", "n", "lo", "hi"))
    state = scoped.withColumn("t", targets).select("g", "p", "all", "m", "n", F.col("t.q").alias("q"), F.greatest(F.col("t.k"), F.lit(1)).alias("k"), F.lit(0).cast("long").alias("below"), F.col("n").alias("c"), "lo", "hi")
    state = materialize(state, "intervals")

    done = [state.where("lo = hi")]
    state, targets_open, inside = _open(state)
    held = inside
    while targets_open:
        state = materialize(_narrow(long, state, targets_open), "intervals")
        done.append(state.where("lo = hi"))
        state, targets_open, inside = _open(state)
        if targets_open and inside * 2 <= held:
            long, held = materialize(_inside(long, state, targets_open), "values"), inside
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    names = F.element_at(F.array(*(F.lit(c) for c in columns)), F.col("m") + 1)
    return result.select(
        F.col("g").alias(group), F.col("p").alias(part), F.when(F.col("all"), "all").otherwise("part").alias("scope"), names.alias("measure"), F.col("q").alias("percent"), "n", F.col("lo").alias("value")
    )


def _open(state: DataFrame) -> tuple[DataFrame, int, int]:
    """The unresolved targets, their number, and how many rows their intervals hold (rows in several counted for each)."""
    left = state.where("lo < hi")
    got = left.groupBy("g", "p", "all", "m", "lo", "hi").agg(F.count("*").alias("t"), F.max("c").alias("c")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    return left, got["t"] or 0, got["c"] or 0


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows * ROW_BYTES <= BROADCAST_BYTES else df


def _asked(long: DataFrame, state: DataFrame, targets: int) -> DataFrame:
    """``long`` with ``xs`` and ``ys``: the open intervals (lo, hi, c) of each value's own part, and those over all parts."""
    interval = F.collect_set(F.struct("lo", "hi", "c"))
    own = state.where(~F.col("all")).groupBy(F.col("g").alias("g1"), F.col("p").alias("p1"), F.col("m").alias("m1")).agg(interval.alias("xs"))
    over = state.where(F.col("all")).groupBy(F.col("g").alias("g2"), F.col("m").alias("m2")).agg(interval.alias("ys"))
    met = long.join(_small(own, targets), _same([(F.col("g"), F.col("g1")), (F.col("p"), F.col("p1")), (F.col("m"), F.col("m1"))]), "left")
    return met.join(_small(over, targets), _same([(F.col("g"), F.col("g2")), (F.col("m"), F.col("m2"))]), "left").select("g", "p", "m", "v", "xs", "ys")


def _inside(long: DataFrame, state: DataFrame, targets: int) -> DataFrame:
    """The rows of ``long`` that lie in some open interval, once each: later passes need no others."""
    holds = lambda sets: F.coalesce(F.exists(sets, lambda x: (F.col("v") >= x["lo"]) & (F.col("v") <= x["hi"])), F.lit(False))
    return _asked(long, state, targets).where(holds("xs") | holds("ys")).select("g", "p", "m", "v")


def _narrow(long: DataFrame, state: DataFrame, open_rows: int) -> DataFrame:
    """One pass: ``state`` with each interval cut down to the piece that holds its target rank."""
    # percentiles of a group that still share an interval are counted once
    keys = ["g", "p", "all", "m", "below", "lo", "hi"]
    intervals = state.groupBy(*keys).agg(F.collect_list(F.struct("q", "k", "n")).alias("targets"))
    tag = lambda sets, scope_all: F.transform(F.coalesce(sets, F.array()), lambda x: F.struct(F.lit(scope_all).alias("all"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["c"].alias("c")))
    every = _asked(long, state, open_rows).select("g", "p", "m", "v", F.explode(F.concat(tag(F.col("xs"), False), tag(F.col("ys"), True))).alias("x")).select("g", "p", "m", "v", "x.*")
    inside = every.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    cell = inside.select("g", "p", "all", "m", "lo", "hi", _piece(F.col("v"), F.col("lo"), F.col("hi"), _pieces(F.col("c"))).alias("piece"), "v")
    by_part = cell.groupBy("g", "p", "all", "m", "lo", "hi", "piece").agg(F.count("*").alias("c"), F.min("v").alias("lo1"), F.max("v").alias("hi1"))
    scope = F.when(~F.col("all"), F.col("p")).alias("p")
    cells = by_part.groupBy("g", scope, "all", "m", "lo", "hi", "piece").agg(F.sum("c").alias("c"), F.min("lo1").alias("lo1"), F.max("hi1").alias("hi1"))
    found = cells.groupBy("g", "p", "all", "m", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("piece", "c", "lo1", "hi1"))).alias("cells"))
    a, b = intervals.alias("a"), found.alias("b")
    same = _same([(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ("g", "p", "all", "m", "lo", "hi")])
    met = a.join(b, same).select("a.*", "b.cells").withColumn("t", F.explode("targets"))
    # the first piece up to which the rows reach the target rank
    step = F.expr(
        """aggregate(cells, struct(below as below, cast(null as double) as lo1, cast(null as double) as hi1, cast(null as bigint) as c),
             (x, c) -> CASE WHEN x.lo1 is not null THEN x
                            WHEN x.below + c.c >= t.k THEN struct(x.below as below, c.lo1 as lo1, c.hi1 as hi1, c.c as c)
                            ELSE struct(x.below + c.c as below, cast(null as double) as lo1, cast(null as double) as hi1, cast(null as bigint) as c) END)"""
    )
    return met.withColumn("x", step).select("g", "p", "all", "m", F.col("t.n").alias("n"), F.col("t.q").alias("q"), F.col("t.k").alias("k"), F.col("x.below").alias("below"), F.col("x.c").alias("c"), F.col("x.lo1").alias("lo"), F.col("x.hi1").alias("hi"))

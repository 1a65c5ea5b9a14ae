"""Ranges [start, end) within a key (lines of a file): running offsets, islands, overlaps, invariants.

A key may hold a third of all rows. Sums and islands over a key's ranges are taken in two levels, within blocks of
positions and over the blocks; overlaps are counted by sorted bounds instead of pairs; the join that does list pairs
meets only in shared blocks of positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def ranges_overlap(s1: Column, e1: Column, s2: Column, e2: Column, adjacent: bool = False) -> Column:
    """Proper overlap, or equal starts, or equal ends, or (if asked for) adjacency; so empty ranges can match."""
    over = ((s1 < e2) & (s2 < e1)) | (s1 == s2) | (e1 == e2)
    return over | (e1 == s2) | (e2 == s1) if adjacent else over


def latest_before(df: DataFrame, keys: Sequence[str], position: str, item: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``earlier``, the (position, item) of the row right before each by (position, item) within ``keys``.

    Taken in two levels like the sums: within blocks of positions, and from the greatest of the blocks before. No nulls.
    """
    rows = df.withColumn("_block", F.floor(F.col(position) / block)).withColumn("_at", F.struct(F.col(position).alias("position"), F.col(item).alias("item")))
    inside = Window.partitionBy(*keys, "_block").orderBy(position, item).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy(*keys, "_block").agg(F.max("_at").alias("_most")).select(*keys, "_block", F.max("_most").over(blocks).alias("_past"))
    here = rows.withColumn("_here", F.max("_at").over(inside))
    return here.join(most, [*keys, "_block"]).select(*df.columns, F.coalesce("_here", "_past").alias("earlier"))


def _with_block_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with one row per (key, block); null keys and blocks match."""
    a, b = rows.alias("a"), totals.alias("b")
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col("a._block").eqNullSafe(F.col("b._block"))
    return a.join(b, same).select("a.*", *(f"b.{c}" for c in totals.columns if c not in (key, "_block")))


def running_sums(df: DataFrame, key: str, position: str, order: Sequence[str], values: Mapping[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with, by name, the sum of each value over the rows of ``key`` before each row by (position, order).

    Rows are ordered within blocks of ``block`` positions, and block totals are summed over blocks, so no task sorts all
    rows of a key. Null positions come first, null values count as 0.
    """
    rows = df.select("*", *(F.coalesce(v, F.lit(0)).alias(f"_v{i}") for i, v in enumerate(values.values()))).withColumn("_block", F.floor(F.col(position) / block))
    before = Window.partitionBy(key, "_block").orderBy(F.asc_nulls_first(position), *order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(key).orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = range(len(values))
    totals = rows.groupBy(key, "_block").agg(*(F.sum(f"_v{i}").alias(f"_t{i}") for i in sums))
    totals = totals.select(key, "_block", *(F.coalesce(F.sum(f"_t{i}").over(blocks), F.lit(0)).alias(f"_b{i}") for i in sums))
    local = rows.select("*", *(F.coalesce(F.sum(f"_v{i}").over(before), F.lit(0)).alias(f"_l{i}") for i in sums))
    return _with_block_totals(local, totals, key).select(*df.columns, *((F.col(f"_l{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(values)))


def running_sum(df: DataFrame, key: str, position: str, item: str, value: Column, name: str) -> DataFrame:
    """One sum of :func:`running_sums`; ``item`` is unique within a key."""
    return running_sums(df, key, position, [item], {name: value})


def with_neighbours(df: DataFrame, key: str, order: Sequence[str], before: Mapping[str, str], behind: Mapping[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with columns of the row right before (and right behind) each row of ``key`` by ``order``: new name -> column.

    Taken in two levels like the sums: within blocks of the first column of ``order``, and from the last row of the block
    before (the first of the block behind). No nulls in ``order``.
    """
    rows = df.withColumn("_block", F.floor(F.col(order[0]) / block))
    inside, blocks = Window.partitionBy(key, "_block").orderBy(*order), Window.partitionBy(key).orderBy("_block")
    edges, out = [], []
    for side, wanted, step, of_block in (("_p", before, F.lag, F.max), ("_n", behind or {}, F.lead, F.min)):
        if not wanted:
            continue
        row = F.struct(*order, *(F.col(c).alias(f"_v{i}") for i, c in enumerate(wanted.values())))
        rows = rows.withColumn(side, step(row).over(inside))
        edges.append(step(of_block(row)).over(blocks).alias(f"{side}_block"))
        out += [F.coalesce(side, f"{side}_block")[f"_v{i}"].alias(name) for i, name in enumerate(wanted)]
    totals = rows.groupBy(key, "_block").agg(*edges)
    return _with_block_totals(rows, totals, key).select(*df.columns, *out)


def island_rows(df: DataFrame, key: str, start: str, end: str, gap: int = 0, block: int = BLOCK) -> DataFrame:
    """``df`` with ``island``, the number within ``key`` (from 1) of the island of each range: ranges are joined while the
    next starts at most ``gap`` behind all before it.

    Taken in two levels like the sums: the reach and the number of islands before a block come from block totals.
    Ranges have no null bounds.
    """
    rows = df.withColumn("_block", F.floor(F.col(start) / block))
    inside = Window.partitionBy(key, "_block").orderBy(start, end)
    blocks = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(key, "_block").agg(F.max(end).alias("_m")).select(key, "_block", F.max("_m").over(blocks).alias("_earlier"))
    reach = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_earlier"))
    opened = _with_block_totals(rows, ends, key).withColumn("_new", (reach.isNull() | (F.col(start) > reach + gap)).cast("int")).drop("_earlier")
    counts = opened.groupBy(key, "_block").agg(F.sum("_new").alias("_n")).select(key, "_block", F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_sofar"))
    # of equal ranges the one that opens an island comes first
    here = Window.partitionBy(key, "_block").orderBy(start, end, F.desc("_new")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = _with_block_totals(opened.withColumn("_here", F.sum("_new").over(here)), counts, key)
    return numbered.select(*df.columns, (F.col("_here") + F.col("_sofar")).alias("island"))


def islands(df: DataFrame, key: str, start: str, end: str, gap: int = 0, block: int = BLOCK) -> DataFrame:
    """(key, island, start, end, members): the islands of :func:`island_rows`."""
    rows = island_rows(df.select(key, start, end), key, start, end, gap, block)
    return rows.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def running_max(df: DataFrame, key: str, position: str, order: Sequence[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``, the greatest ``value`` over the rows of ``key`` before each row by (position, order), in two levels
    like the sums; null if there is none. No nulls in ``position``."""
    rows = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(position) / block))
    before = Window.partitionBy(key, "_block").orderBy(position, *order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy(key, "_block").agg(F.max("_v").alias("_m")).select(key, "_block", F.max("_m").over(blocks).alias("_past"))
    local = rows.withColumn("_here", F.max("_v").over(before))
    return _with_block_totals(local, most, key).select(*df.columns, F.greatest("_here", "_past").alias(name))


def padded(df: DataFrame, fences: DataFrame, key: str, item: str, start: str, end: str, margin: int) -> DataFrame:
    """(key, item, start, end): ranges widened by ``margin`` on both sides, but not into the nearest of the ``fences`` of their
    key that end at or before their start, or start at or after their end; nor below 0.

    The nearest fences are running maxima over sorted bounds, so no pair is built. Ranges and fences have no nulls.
    """
    long = lambda c: F.col(c).cast("long")
    asks = df.select(F.col(key).alias("k"), F.col(item).alias("i"), long(start).alias("s"), long(end).alias("e"))
    bars = fences.select(F.col(key).alias("k"), long(start).alias("s"), long(end).alias("e"))

    def nearest(ask: Column, bar: Column, name: str) -> DataFrame:
        none = F.lit(None)
        events = asks.select("k", "i", ask.alias("x"), F.lit(1).alias("o"), none.cast("long").alias("v")).unionByName(bars.select("k", none.cast(dict(asks.dtypes)["i"]).alias("i"), bar.alias("x"), F.lit(0).alias("o"), bar.alias("v")))
        return running_max(events, "k", "x", ["o"], F.col("v"), name).where("o = 1").select("i", name)

    low = nearest(F.col("s"), F.col("e"), "low")
    high = nearest(-F.col("e"), -F.col("s"), "high")
    met = asks.join(low, "i").join(high, "i")
    return met.select(F.col("k").alias(key), F.col("i").alias(item), F.greatest(F.col("s") - margin, F.coalesce("low", F.lit(0)), F.lit(0)).alias(start), F.least(F.col("e") + margin, -F.col("high")).alias(end))


def overlap_counts(df: DataFrame, others: DataFrame, key: str, item: str, start: str, end: str) -> DataFrame:
    """(item, overlaps): with how many non-empty ranges of ``others`` with its key each non-empty range properly overlaps.

    That is the number that start before its end minus the number that end at or before its start; both are running
    counts over sorted bounds, so no pair is built.
    """
    ask = df.where(F.col(start) < F.col(end)).select(F.col(key).alias("k"), F.col(item).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"))
    have = others.where(F.col(start) < F.col(end)).select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bounds = (
        have.select("k", F.col("s").alias("x"), F.lit(1).alias("o"), one.alias("starts"), none.alias("ends"), F.lit(None).cast("long").alias("i"), none.alias("at_end"))
        .unionByName(have.select("k", F.col("e").alias("x"), F.lit(0).alias("o"), none.alias("starts"), one.alias("ends"), F.lit(None).cast("long").alias("i"), none.alias("at_end")))
        .unionByName(ask.select("k", F.col("e").alias("x"), F.lit(0).alias("o"), none.alias("starts"), none.alias("ends"), F.col("i").cast("long").alias("i"), one.alias("at_end")))
        .unionByName(ask.select("k", F.col("s").alias("x"), F.lit(2).alias("o"), none.alias("starts"), none.alias("ends"), F.col("i").cast("long").alias("i"), none.alias("at_end")))
    )
    # at an end: ranges that start before it (o = 0 sorts before starts at the same place); at a start: those that ended
    seen = running_sums(bounds, "k", "x", ["o"], {"n_starts": F.col("starts"), "n_ends": F.col("ends")})
    per = seen.where("i is not null").groupBy("k", "i").agg(F.max(F.when(F.col("at_end") == 1, F.col("n_starts"))).alias("a"), F.max(F.when(F.col("at_end") == 0, F.col("n_ends"))).alias("b"))
    return per.select(F.col("i").alias(item), (F.col("a") - F.col("b")).alias("overlaps"))


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, item: str, start: str, end: str, width: int = BLOCK) -> DataFrame:
    """(left item, right item) of all properly overlapping ranges with the same key.

    Ranges are laid on blocks of ``width`` positions and meet in shared blocks; a pair is kept only in the block where
    the later of its starts lies, so it comes out once.
    """
    block = lambda c: F.floor(c / width)
    laid = lambda df, a: df.where(F.col(start) < F.col(end)).select(F.col(key).alias("k"), F.col(item).alias(f"i{a}"), F.col(start).alias(f"s{a}"), F.col(end).alias(f"e{a}"), F.explode(F.sequence(block(F.col(start)), block(F.col(end) - 1))).alias("b"))
    met = laid(left, 1).join(laid(right, 2), ["k", "b"]).where((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    return met.where(F.col("b") == block(F.greatest("s1", "s2"))).select(F.col("i1").alias("left_item"), F.col("i2").alias("right_item"))


def match_counts(df: DataFrame, others: DataFrame, key: str, item: str, start: str, end: str) -> DataFrame:
    """(item, matches): with how many ranges of ``others`` with its key each range overlaps by :func:`ranges_overlap`.

    Empty ranges count on both sides, and every range comes out, with 0 if it has a null or matches nothing; no range
    ends before its start. Of the ranges that start up to its end, those that end before its start do not match; where
    a bound is met exactly, the order of the bounds at that place tells which of the two rules holds. No pair is built.
    """
    whole = F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()
    named = lambda d: d.where(whole).select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"), (F.col(start) == F.col(end)).alias("empty"))
    have = named(others)
    ask = df.where(whole).select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"), (F.col(start) == F.col(end)).alias("empty"), F.col(item).alias("i"))
    one, none, no_item = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(None).cast(dict(df.dtypes)[item])
    order = lambda of_empty, of_others: F.when(F.col("empty"), of_empty).otherwise(of_others)
    bound = lambda d, at, o, starts, ends, i, sign: d.select("k", F.col(at).alias("x"), o.alias("o"), starts.alias("starts"), ends.alias("ends"), i.alias("i"), F.lit(sign).alias("sign"))
    # at one place: the start of an empty asker (no end there is before it), ends of others and empty starts, bounds of
    # other askers, starts of others and empty ends, the end of an empty asker (all starts there match it)
    bounds = bound(have, "s", order(1, 3), one, none, no_item, 0).unionByName(bound(have, "e", order(3, 1), none, one, no_item, 0))
    bounds = bounds.unionByName(bound(ask, "e", order(4, 2), none, none, F.col("i"), 1)).unionByName(bound(ask, "s", order(0, 2), none, none, F.col("i"), -1))
    seen = running_sums(bounds, "k", "x", ["o"], {"n_starts": F.col("starts"), "n_ends": F.col("ends")}).where("sign <> 0")
    found = seen.select("i", F.when(F.col("sign") == 1, F.col("n_starts")).otherwise(-F.col("n_ends")).alias("n"))
    partial = df.where(~whole).select(F.col(item).alias("i"), none.alias("n"))
    return found.unionByName(partial).groupBy("i").agg(F.sum("n").alias("matches")).withColumnRenamed("i", item)


def match_pairs(left: DataFrame, right: DataFrame, key: str, item: str, start: str, end: str, width: int = BLOCK) -> DataFrame:
    """(left item, right item) of all ranges with the same key that overlap by :func:`ranges_overlap`, empty ones too.

    Blocks as in :func:`overlap_pairs`, but a range is laid on the block of its end as well: the later of two starts
    lies, ends included, in both ranges of every pair. No range ends before its start.
    """
    block = lambda c: F.floor(c / width)
    laid = lambda df, a: df.select(F.col(key).alias("k"), F.col(item).alias(f"i{a}"), F.col(start).alias(f"s{a}"), F.col(end).alias(f"e{a}"), F.explode(F.sequence(block(F.col(start)), block(F.col(end)))).alias("b"))
    met = laid(left, 1).join(laid(right, 2), ["k", "b"]).where(ranges_overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))
    return met.where(F.col("b") == block(F.greatest("s1", "s2"))).select(F.col("i1").alias("left_item"), F.col("i2").alias("right_item"))


def _accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, reach, first = None, None, True
    for batch in batches:
        keep = []
        for n, (k, s, e, island) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)):
            if first or (k, island) != key:
                key, reach, first = (k, island), None, False
            if reach is None or s >= reach:
                keep.append(n)
                reach = e
        yield batch.select([0, 1, 2, 3]).take(pa.array(keep, pa.int64()))


def accept_disjoint(df: DataFrame, key: str, item: str, start: str, end: str) -> DataFrame:
    """(key, start, end, item): ranges in order of (start, end, item), each kept unless it overlaps one kept before.

    The first range of an island of overlapping ranges overlaps none before it, so islands are settled apart, each by one
    sorted pass that holds a single bound; a hot key is spread over its islands.
    """
    kinds = dict(df.dtypes)
    rows = island_rows(df.select(key, start, end, item), key, start, end, gap=-1)
    sorted_rows = rows.repartition(key, "island").sortWithinPartitions(key, "island", start, end, item).select(key, start, end, item, "island")
    return sorted_rows.mapInArrow(_accept, ", ".join(f"{c} {kinds[c]}" for c in (key, start, end, item)))


def sum_before(marks: DataFrame, ranges: DataFrame, key: str, item: str, position: str, end: str, value: Column) -> DataFrame:
    """(item, total): for each mark the sum of ``value`` over the ranges of its key that end at or before it."""
    add = ranges.select(F.col(key).alias("k"), F.col(end).alias("x"), F.lit(0).alias("o"), value.cast("long").alias("v"), F.lit(None).cast("long").alias("i"))
    ask = marks.select(F.col(key).alias("k"), F.col(position).alias("x"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("v"), F.col(item).cast("long").alias("i"))
    total = running_sums(add.unionByName(ask), "k", "x", ["o"], {"total": F.col("v")})
    return total.where("o = 1").select(F.col("i").alias(item), "total")


def violations(df: DataFrame, key: str, item: str, start: str, end: str) -> DataFrame:
    """(item, rule) of ranges that break an order: end before start, or start before the end of the range before."""
    rows = with_neighbours(df.select(key, start, end, item), key, [start, end, item], {"_before": end})
    before = F.col("_before")
    rules = F.array_compact(F.array(F.when(F.col(end) < F.col(start), "reversed"), F.when(F.col(start) < before, "crosses_previous"), F.when((F.col(start) == F.col(end)) & (before == F.col(start)), "empty_not_apart")))
    return rows.withColumn("rules", rules).select(item, F.explode("rules").alias("rule"))


def gaps_around(df: DataFrame, key: str, item: str, start: str, end: str, size: int) -> DataFrame:
    """Each range with the end of the one before (default 0) and the start of the one behind (default ``size``)."""
    rows = with_neighbours(df.select(key, start, end, item), key, [start, end, item], {"_before": end}, {"_behind": start})
    return rows.select(item, F.coalesce("_before", F.lit(0)).alias("previous_end"), F.coalesce("_behind", F.lit(size)).alias("next_start"))

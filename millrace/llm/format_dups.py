"""Duplicates hidden by formatting differences: recursive radix partitioning on canonical bytes, counted in tries.

A record's canonical form keeps what must agree (letters and digits without case; the parts of a list in sorted order).
Buckets are prefixes of canonical forms. All rows start in one bucket; a bucket of more than ``FIT`` rows is split by
further characters, twice as many each level, until each fits. A bucket too large to fit whose rows all have the same
form is settled at once: it is a hot set of copies, its least identifier and its size are known from the level's counts,
and its rows are never moved. Every other bucket goes to one task, which walks a trie of its forms; each terminal node
has a counter of the least identifier and the number of copies, from which :func:`collapsed` takes its rows.

``FIT`` is the same at every size of the table. Level counts are combined on the map side. The list of oversized prefixes
is broadcast while it is below ``BROADCAST_BYTES`` (checked, not assumed), else met by a shuffle join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

STEP = 12
FIT = 4000
BROADCAST_BYTES = 16 << 20
SPLIT_BYTES = 64
NOT_KEPT = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Letters and digits of ``text`` in order, without case (sharp s counts as ss)."""
    kept = F.regexp_replace(F.regexp_replace(text, NOT_KEPT, ""), "[ßẞ]", "ss")
    return F.lower(F.upper(kept))


def canonical_list(text: Column, separator: str = ",") -> Column:
    """The canonical parts of a list in sorted order, empty ones left out; null is the empty list."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), canonical), lambda x: x != "")
    return F.array_join(F.sort_array(parts), "\u0001")


def keyed(df: DataFrame, item: str, text: str, lists: Sequence[str] = ()) -> DataFrame:
    """(``id``, ``form``): the canonical form of each row with a letter or digit in ``text``."""
    body = canonical(F.col(text))
    form = F.concat_ws("\u0000", body, *(canonical_list(F.col(c)) for c in lists))
    return df.select(F.col(item).cast("long").alias("id"), body.alias("body"), form.alias("form")).where(F.col("body") != "").select("id", "form")


class Trie:
    """Forms in chunks of characters; a terminal node holds [least identifier, copies]."""

    CHUNK = 24

    def __init__(self) -> None:
        self.root: dict = {}
        self.counters: list[list[int]] = []

    def add(self, form: str, ident: int) -> tuple[int, int]:
        node, size = self.root, self.CHUNK
        for at in range(0, len(form), size):
            piece = form[at : at + size]
            child = node.get(piece)
            if child is None:
                child = node[piece] = {}
            node = child
        counter = node.get(None)
        if counter is None:
            counter = node[None] = [ident, 0]
            self.counters.append(counter)
        counter[1] += 1
        return counter[0], counter[1]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, form) -> (kept, id). Rows come sorted by (bucket, id); each bucket has a trie of its own."""
    bucket, trie = None, Trie()
    for batch in batches:
        kept = []
        for b, ident, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                bucket, trie = b, Trie()
            kept.append(trie.add(form, ident)[0])
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), batch.column(1)], ["kept", "id"])


def _terminals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, form) -> (kept, copies): the counters of each bucket's terminal nodes when the bucket ends."""
    bucket, trie = None, Trie()
    for batch in batches:
        done: list[list[int]] = []
        for b, ident, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                done += trie.counters
                bucket, trie = b, Trie()
            trie.add(form, ident)
        yield _counters(done)
    yield _counters(trie.counters)


def _counters(found: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["kept", "copies"])


def _splits(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows * SPLIT_BYTES <= BROADCAST_BYTES else df


class Buckets:
    """The rows (``id``, ``form``) of a table in buckets that fit, and the hot sets that were settled on the way.

    ``rest`` has (``bucket``, ``id``, ``form``), sorted within partitions; ``hot`` has (``kept``, ``id``) and ``settled``
    (``kept``, ``copies``) of the hot sets.
    """

    def __init__(self, keys: DataFrame) -> None:
        total = keys.count()
        splits: list[tuple[int, DataFrame, int]] = []
        depth, open_rows = STEP, keys
        while total > FIT:
            level = open_rows.groupBy(_prefix(depth).alias("prefix")).agg(
                F.count("*").alias("n"), F.min("id").alias("least"), *(f(F.xxhash64("form", F.lit(seed))).alias(f"{f.__name__}{seed}") for seed in (1, 2) for f in (F.min, F.max))
            )
            same = (F.col("min1") == F.col("max1")) & (F.col("min2") == F.col("max2"))
            large = materialize(level.where(F.col("n") > FIT).select("prefix", "n", "least", same.alias("same")), "level")
            found = large.agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("open")).first()
            splits.append((depth, large, found["n"]))
            if not found["open"]:
                break
            open_rows = open_rows.join(_splits(large.where("not same").select("prefix"), found["open"]), _prefix(depth) == F.col("prefix"), "left_semi")
            depth *= 2
        # each row's bucket is its shortest prefix that is not split; a settled prefix gives the kept identifier as well
        rows = keys.select("id", "form", F.lit(None).cast("binary").alias("bucket"), F.lit(total > FIT).alias("open"), F.lit(None).cast("long").alias("kept"))
        for depth, large, n in splits:
            met = rows.join(_splits(large.drop("n"), n), F.col("open") & (_prefix(depth) == F.col("prefix")), "left")
            rows = met.select(
                "id", "form", F.when(F.col("open"), _prefix(depth)).otherwise(F.col("bucket")).alias("bucket"), (F.col("open") & F.coalesce(~F.col("same"), F.lit(False))).alias("open"), F.coalesce("kept", F.when(F.col("same"), F.col("least"))).alias("kept")
            )
        self.hot = rows.where(F.col("kept").isNotNull()).select("kept", "id")
        settled = [large.where("same").select(F.col("least").alias("kept"), F.col("n").alias("copies")) for _, large, _ in splits]
        self.settled = reduce(DataFrame.unionByName, settled) if settled else None
        rest = rows.where(F.col("kept").isNull()).select(F.coalesce("bucket", F.lit(b"")).alias("bucket"), "id", "form")
        self.rest = rest.repartition("bucket").sortWithinPartitions("bucket", "id")


def members(df: DataFrame, item: str, text: str, lists: Sequence[str] = ()) -> DataFrame:
    """(``kept``, ``id``): for each row with a letter or digit in ``text`` the least identifier of its set of equal rows.

    ``item`` is an integer column without nulls; rows whose text is null or has no letter or digit are left out. Rows
    with the same identifier and form are copies of each other like any. An empty table gives no rows.
    """
    buckets = Buckets(materialize(keyed(df, item, text, lists), "forms"))
    return buckets.rest.mapInArrow(_walk, "kept long, id long").unionByName(buckets.hot)


def _prefix(depth: int) -> Column:
    """The first ``depth`` characters of a form, as a digest of 128 bits."""
    return F.unhex(F.md5(F.substring("form", 1, depth)))


def duplicates(df: DataFrame, item: str, text: str, lists: Sequence[str] = ()) -> DataFrame:
    """(``kept``, ``copy``): one row for each row that is a copy of one with a smaller identifier."""
    return members(df, item, text, lists).where(F.col("kept") != F.col("id")).select("kept", F.col("id").alias("copy"))


def collapsed(df: DataFrame, item: str, text: str, lists: Sequence[str] = ()) -> DataFrame:
    """(``kept``, ``copies``): one row per set of equal rows with its size, single rows included, from the terminal counters."""
    buckets = Buckets(materialize(keyed(df, item, text, lists), "forms"))
    counted = buckets.rest.mapInArrow(_terminals, "kept long, copies long")
    return counted.unionByName(buckets.settled) if buckets.settled else counted

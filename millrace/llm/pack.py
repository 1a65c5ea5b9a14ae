"""Filling of fixed-capacity containers by harmonic packing.

A length in (capacity / (k + 1), capacity / k] is of class k, and k items of class k always fit. Items are hashed onto
workers of about ``PER_WORKER`` items each; every worker fills the containers of each class with the class's fixed
count, largest items first, independently of all others. The space that a container of class k then still has is
itself put into a class: with room r it takes items of class ceil(capacity / r) or above, which fit whatever their
exact length, until none does. Items that exceed the capacity are split into full pieces and a rest before.

The number of workers grows with the number of pieces, so that no task holds more than a few times ``PER_WORKER``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokenizer import BYTE_BPE_50K, encode, load
from millrace.storage import materialize

PER_WORKER = 20_000


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            sizes = pa.array([len(encode(coder, t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], ["i", "size"])

    return run


def token_sizes(df: DataFrame, item: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(``item``, ``size``): the number of tokens of each text that is neither null nor empty."""
    slim = df.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col("t") != "")
    kind = dict(slim.dtypes)["i"]
    return slim.mapInArrow(_counter(path), f"i {kind}, size long").withColumnRenamed("i", item)


def fill(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item, containers numbered from 0. All sizes are in 1..capacity."""
    pools: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], -i)):
        pools.setdefault(capacity // sizes[i], []).append(i)
    classes = sorted(pools)
    place, number = [0] * len(sizes), 0
    for at, k in enumerate(classes):
        pool = pools[k]
        while pool:
            room = capacity
            for _ in range(min(k, len(pool))):
                i = pool.pop()
                place[i], room = number, room - sizes[i]
            for finer in classes[at:]:
                while room > 0 and finer >= -(-capacity // room) and pools[finer]:
                    i = pools[finer].pop()
                    place[i], room = number, room - sizes[i]
            number += 1
    return place


def packed(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(``item``, ``part``, ``start``, ``size``, ``container``): where each piece of each item lies.

    Items of at most ``capacity`` are one piece (part 0, start 0); larger ones are cut into pieces of ``capacity`` and a
    rest. Rows without a positive size are not placed. Rows with the same item are items of their own. ``container``
    is worker * 2**32 + number. Other columns are not read. An empty table gives no rows.
    """
    slim = items.select(F.col(item).alias("i"), F.col(size).cast("long").alias("s")).where(F.col("s") > 0)
    piece = F.explode(F.sequence(F.lit(0), ((F.col("s") - 1) / capacity).cast("int")))
    pieces = slim.select("i", "s", piece.alias("part")).withColumn("start", F.col("part").cast("long") * capacity)
    pieces = materialize(pieces.select("i", "part", "start", F.least(F.col("s") - F.col("start"), F.lit(capacity)).alias("size"), F.monotonically_increasing_id().alias("serial")), "pieces")
    workers = max(1, -(-pieces.count() // PER_WORKER))

    def work(table: pa.Table) -> pa.Table:
        # the same pieces give the same containers, in whatever order they come
        table = table.sort_by([("i", "ascending"), ("part", "ascending")])
        place = fill(table.column("size").to_pylist(), capacity)
        base = int(table.column("worker")[0].as_py()) << 32
        out = table.select(["i", "part", "start", "size"])
        return out.append_column("container", pa.array([base + p for p in place], pa.int64()))

    # an item and part name a piece, so its worker does not depend on how the files are split; repeated ones are salted
    often = pieces.groupBy("i", "part").agg(F.count("*").alias("n")).where("n > 1")
    salt = F.lit(None).cast("long")
    if often.limit(1).count():
        pieces = pieces.alias("a").join(often.alias("b"), F.col("a.i").eqNullSafe(F.col("b.i")) & (F.col("a.part") == F.col("b.part")), "left").select("a.*", "n")
        salt = F.when(F.col("n") > 1, F.col("serial"))
    spread = pieces.withColumn("worker", F.pmod(F.xxhash64("i", "part", salt), F.lit(workers)))
    kind = dict(slim.dtypes)["i"]
    return spread.groupBy("worker").applyInArrow(work, f"i {kind}, part int, start long, size long, container long").withColumnRenamed("i", item)

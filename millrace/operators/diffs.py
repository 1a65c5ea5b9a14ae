"""Line and word differences between two columns, in order.

What lines two texts have in common, in order, has no column expression: a longest common subsequence is aligned per row
in Arrow batches. All that is made from it are Spark expressions on rows of lines: sides, context, hunks, headers and
the diff as a text. The diff turns the first text into the second. Rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.hunks import rendered

_WORD = re.compile(r"[A-Za-z0-9_]+")
NO_END = "\\ No newline at end of file"


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places (in ``a``, in ``b``) of a longest common subsequence, in order.

    Equal beginnings and ends are taken off. A row of bits for each element of ``b`` tells where the length grows along
    ``a``; the places are read from the rows backwards.
    """
    n, m, lead = len(a), len(b), 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    while n > lead and m > lead and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    at: dict[str, int] = {}
    for i, x in enumerate(a[lead:n]):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << n - lead) - 1
    rows = [every]
    for x in b[lead:m]:
        v = rows[-1]
        u = v & at.get(x, 0)
        rows.append(((v + u) | (v - u)) & every)
    inner, i, j = [], n - lead, m - lead
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
        elif not rows[j - 1] >> i - 1 & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            inner.append((lead + i, lead + j))
    return [*((k, k) for k in range(lead)), *reversed(inner), *((n + k, m + k) for k in range(len(a) - n))]


def _script(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            la, lb = _lines(a), _lines(b)
            out, i, j = [], 0, 0
            for x, y in [*aligned(la, lb), (len(la), len(lb))]:
                out += [("-", t) for t in la[i:x]] + [("+", t) for t in lb[j:y]] + [(" ", t) for t in la[x : x + 1]]
                i, j = x + 1, y + 1
            rows.append([{"sign": s, "line": t} for s, t in out])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct([("sign", pa.string()), ("line", pa.string())])))], ["i", "script"])


def line_script(df: DataFrame, item: str, before: str, after: str) -> DataFrame:
    """(item, ``pos``, ``sign``, ``line``): the lines of both texts in order, `` `` for common ones, ``-`` for those of the first
    text only and ``+`` for those of the second. Rows with a null text have none. ``item`` is unique."""
    rows = df.where(F.col(before).isNotNull() & F.col(after).isNotNull()).select(F.col(item).alias("i"), F.col(before).alias("a"), F.col(after).alias("b"))
    script = rows.mapInArrow(_script, f"i {dict(rows.dtypes)['i']}, script array<struct<sign:string,line:string>>")
    return script.select(F.col("i").alias(item), F.posexplode("script").alias("pos", "x")).select(item, "pos", "x.sign", "x.line")


def line_hunks(df: DataFrame, item: str, before: str, after: str, n: int = 1) -> DataFrame:
    """(item, ``hunk``, ``base_start``, ``base_len``, ``remote_start``, ``remote_len``, ``body``): the hunks of the diffs with ``n``
    unchanged lines around changes; starts count from 1, and are that of the line before if a side has no line."""
    w = Window.partitionBy(item).orderBy("pos")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    changed = F.col("sign") != " "
    mark = F.when(changed, F.col("pos"))
    near = line_script(df, item, before, after).select(
        "*", F.max(mark).over(past).alias("last"), F.min(mark).over(ahead).alias("next"), F.sum((F.col("sign") != "+").cast("long")).over(past).alias("base_no"), F.sum((F.col("sign") != "-").cast("long")).over(past).alias("remote_no")
    )
    kept = near.where((F.col("pos") - F.col("last") <= n) | (F.col("next") - F.col("pos") <= n))
    opened = kept.withColumn("hunk", F.sum(F.coalesce((F.col("pos") - F.lag("pos").over(w) > 1).cast("long"), F.lit(0))).over(w) + 1)
    ended = F.regexp_replace("line", r"\n\z", "")
    text = F.concat("sign", ended, F.when(~F.col("line").endswith("\n"), F.lit("\n" + NO_END)).otherwise(""))
    side = lambda sign, no: (F.min(F.when(F.col("sign") != sign, F.col(no))), F.min(no), F.count_if(F.col("sign") != sign))
    (b1, b0, bn), (r1, r0, rn) = side("+", "base_no"), side("-", "remote_no")
    grouped = opened.groupBy(item, "hunk").agg(F.coalesce(b1, b0).alias("base_start"), bn.alias("base_len"), F.coalesce(r1, r0).alias("remote_start"), rn.alias("remote_len"), F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).alias("x"))
    return grouped.select(item, "hunk", "base_start", "base_len", "remote_start", "remote_len", F.transform("x", lambda v: v["t"]).alias("body"))


def line_diffs(df: DataFrame, item: str, before: str, after: str, n: int = 1) -> DataFrame:
    """(item, diff): null for equal texts and where either is null. Other columns are not read; ``item`` is unique."""
    texts = line_hunks(df, item, before, after, n).select(item, "hunk", rendered(*(F.col(c) for c in ("base_start", "base_len", "remote_start", "remote_len", "body"))).alias("t"))
    whole = texts.groupBy(item).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hunk", "t"))), lambda v: v["t"]), "").alias("diff"))
    return df.select(item).join(whole, item, "left")


def common_words(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, bit-parallel over the first list."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            wa, wb = _WORD.findall(a), _WORD.findall(b)
            kept = common_words(wa, wb)
            found.append((len(wa) - kept, len(wb) - kept, kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[j] for f in found], pa.int64()) for j in range(3))], ["item", "gone", "new", "kept"])


def word_counts(df: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """(item, ``gone``, ``new``, ``kept``): words in order, so moves and repeated words count; rows with a null are left out.

    ``kept`` is the longest common subsequence of the two sides' words (ASCII letters, digits and underscores).
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(item).cast("long").alias("item"), a, b)
    return rows.mapInArrow(_word_counts, "item long, gone long, new long, kept long").withColumnRenamed("item", item)

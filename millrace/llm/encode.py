"""Encoding of a corpus with a public tokenizer, reusing content-defined chunks.

A rolling hash over the bytes of a text decides where chunks end, so a passage that stands in several documents gives
the same chunks in all of them, wherever it stands. Only digests of chunks are counted; a chunk that stands in more than
one place is encoded once, by the first document that holds it, and its ids are joined to the others. A chunk's own
encoding holds only between its first and last sure pre-token start; what is left at both sides is put together with
the text around it and encoded anew, over as many chunks as it takes to reach the next sure start, so the result equals the
encoding of the whole text id by id.

Chunks that stand in one place never travel: their documents encode them in place. What is shuffled are digests, and the ids of
shared chunks once for each place. Texts meet the shared ids by a broadcast while those are below ``BROADCAST_BYTES``
(checked, not assumed), else by a shuffle join. Hot chunks and hot texts are merged on the map side, and the joins
that repeat them are split by the skew handling of adaptive joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokenizer import BYTE_BPE_50K, SURE, encode, load
from millrace.storage import materialize

WINDOW = 32
CHUNK_BITS = 8
WORK_BYTES = 4 << 20
BROADCAST_BYTES = 16 << 20
OWNER_BYTES = 48
U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _ends(data: np.ndarray) -> np.ndarray:
    """Positions behind windows whose hash has the zero bits."""
    with np.errstate(over="ignore"):
        h = (data.astype(U) + U(1)) * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(29)
        width, factor = 1, _STEP
        while width < WINDOW:
            h[width:] = h[width:] + U(factor) * h[:-width]
            width, factor = width * 2, factor * factor % (1 << 64)
        h = (h ^ (h >> U(32))) * U(_STEP)
    return np.flatnonzero(h[WINDOW - 1 :] >> U(64 - CHUNK_BITS) == 0) + WINDOW


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in ``data`` (UTF-8 bytes of several texts) at which chunks start, text bounds included.

    A chunk starts after every window of ``WINDOW`` bytes within a text whose hash has ``CHUNK_BITS`` zero bits at the
    top, moved on to the next start of a character.
    """
    n = len(data)
    at = np.concatenate([_ends(data[max(0, a - WINDOW) : a + WORK_BYTES]) + max(0, a - WINDOW) for a in range(0, n, WORK_BYTES)] or [np.zeros(0, np.int64)])
    text = np.searchsorted(offsets, at, side="right") - 1
    at = at[(at < n) & (at - offsets[np.minimum(text, len(offsets) - 2)] >= WINDOW)]
    for _ in range(3):
        at = np.where((at < n) & (data[np.minimum(at, n - 1)] & 0xC0 == 0x80), at + 1, at)
    return np.unique(np.concatenate([offsets, at[at < n]]))


def _chunked(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(row, chunks in order) of each text that is not empty; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return
    at, raw = cuts(data, offsets), data.tobytes()
    text = np.searchsorted(offsets, at[:-1], side="right") - 1
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    for a, b in zip(first, np.append(first[1:], len(text)), strict=True):
        yield int(text[a]), [raw[x:y] for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, text) -> (h, pos, c): the digests of the chunks of each text."""
    for batch in batches:
        rows, pos, digests = [], [], []
        for row, chunks in _chunked(batch.column(1)):
            rows += [row] * len(chunks)
            pos += range(len(chunks))
            digests += (md5(c, usedforsecurity=False).digest() for c in chunks)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(digests, pa.binary())], ["h", "pos", "c"])


def _owner(path: str):
    """(text, positions) -> (c, sure, head, ids, tail) of the chunks at the positions: the text before the first sure start,
    the ids up to the last one, and the text behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            owned, rows = batch.column(1).to_pylist(), []
            for row, chunks in _chunked(batch.column(0)):
                for p in owned[row]:
                    chunk = chunks[p].decode()
                    starts = [m.start() for m in SURE.finditer(chunk)]
                    key = md5(chunks[p], usedforsecurity=False).digest()
                    rows.append((key, True, chunk[: starts[0]], encode(coder, chunk[starts[0] : starts[-1]]), chunk[starts[-1] :]) if starts else (key, False, chunk, [], ""))
            c, sure, head, ids, tail = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(sure, pa.bool_()), pa.array(head, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(tail, pa.string())], ["c", "sure", "head", "ids", "tail"])

    return run


def _encoder(path: str):
    """(i, text, given parts in order) -> (i, ids): given ids are taken, all between them is encoded in place."""

    def whole(coder, chunks: list[bytes], given: pa.Array) -> np.ndarray:
        pos, sure, head, ids, tail = given.flatten()
        ends, values = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))), ids.flatten().to_numpy()
        pieces, open_text, done = [], [], 0
        for k, (p, s, h, t) in enumerate(zip(pos.to_pylist(), sure.to_pylist(), head.to_pylist(), tail.to_pylist(), strict=True)):
            open_text += [b"".join(chunks[done:p]).decode(), h]
            done = p + 1
            if s:
                pieces += [encode(coder, "".join(open_text)), values[ends[k] : ends[k + 1]]]
                open_text = [t]
        pieces.append(encode(coder, "".join(open_text) + b"".join(chunks[done:]).decode()))
        return np.concatenate([np.asarray(x, np.int32) for x in pieces])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            given = batch.column(2)
            has = given.is_valid().to_pylist()
            ids = [None if h else np.asarray(encode(coder, t or ""), np.int32) for t, h in zip(batch.column(1).to_pylist(), has, strict=True)]
            rows = [r for r, h in enumerate(has) if h]
            for n, chunks in _chunked(batch.column(1).take(pa.array(rows, pa.int64()))) if rows else ():
                ids[rows[n]] = whole(coder, chunks, given[rows[n]].values)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["i", "ids"])

    return run


def _sized(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(``h``, ``pos``, ``c``, ``own``): once each, the places of the chunks of ``docs`` (h, t) that stand in more than one
    place; ``own`` marks the least place of a chunk."""
    marks = materialize(docs.mapInArrow(_marks, "h binary, pos int, c binary"), "marks")
    shared = marks.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("h", "pos")).alias("least")).where("n > 1").select("c", "least")
    places = marks.join(shared, "c").select("h", "pos", "c", (F.struct("h", "pos") == F.col("least")).alias("own"))
    return materialize(places.distinct(), "shared")


def encoded(df: DataFrame, item: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(``item``, ``ids``): the token ids of every row's text, as an array of int; empty and null texts give [].

    Every row gives a row, whatever its ``item`` (repeated and null ones too). Other columns are not read. An empty
    table gives no rows.
    """
    docs = df.select(F.col(item).alias("i"), F.col(text).alias("t")).withColumn("h", F.when(F.col("t") != "", F.unhex(F.md5("t"))))
    places = shared_chunks(docs.where(F.col("h").isNotNull()).select("h", "t"))
    owners = places.where("own").groupBy("h").agg(F.sort_array(F.collect_list("pos")).alias("owned"))
    own = docs.select("h", "t").join(_sized(owners, places.where("own").count() * OWNER_BYTES), "h")
    # copies of a text are one
    own = own.groupBy("h").agg(F.any_value("t").alias("t"), F.any_value("owned").alias("owned"))
    coded = own.select("t", "owned").mapInArrow(_owner(path), "c binary, sure boolean, head string, ids array<int>, tail string")
    given = places.select("h", "pos", "c").join(coded, "c").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("pos", "sure", "head", "ids", "tail"))).alias("parts"))
    given = materialize(given, "given")
    size = given.select(F.sum(F.aggregate("parts", F.lit(64).cast("long"), lambda n, x: n + 64 + 4 * F.size(x["ids"]) + F.octet_length(x["head"]) + F.octet_length(x["tail"]))).alias("n")).first()["n"] or 0
    kind = dict(docs.dtypes)["i"]
    ids = docs.join(_sized(given, size), "h", "left").select("i", "t", "parts").mapInArrow(_encoder(path), f"i {kind}, ids array<int>")
    return ids.withColumnRenamed("i", item)

"""Near-duplicate records with small edits, by the generalised pigeonhole principle on sketch codes.

A record is the set of its word shingles over several fields. Its code is a min-hash sketch of ``SLOTS`` slots: two
records with similarity J agree in a slot with probability J, so records at the threshold differ in few slots. Codes
that differ in at most D slots are found by the generalised pigeonhole principle: the slots are grouped into
partitions, partition i gets a threshold T_i, and if the sum of (T_i + 1) exceeds D, two such codes differ in at most
T_i slots of some partition. A partition of r slots with threshold T is probed by the hashes of its (r - T)-subsets;
a threshold of -1 leaves the partition out.

* Correlated bits stay together: the bits of one slot flip together and are never parted, and slots that agree in the same
  pairs of records (as under shared boilerplate) are put into one partition. How often two slots agree together is
  estimated from hashed counts of their joint values over *all* codes (:func:`correlated`).
* Candidate counts are estimated in the same way for every partition and threshold (:func:`_candidates`), and the T_i are
  the cheapest choice by dynamic programming (:func:`allocate`).
* D is not fixed: it is the least number for which the chance that a pair at the threshold of similarity meets in no
  partition is at most ``LOSS`` (:func:`missed`), whatever ``percent`` is.
* Candidates are verified on the exact shingle sets.

Records with the same set are one code, their *class*, so groups of exact copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import components
from millrace.storage import materialize

SLOTS = 40
PARTITION = 4
#: Greatest chance that a pair right at the threshold is not found; it falls quickly above the threshold.
LOSS = 1e-5
BUCKETS = 1024
JOINT_BUCKETS = 256
#: How many count vectors are added up in one group at a time.
FAN_IN = 512
RANK_PARTS = 64
HOT = 256
WORK_BYTES = 4 << 20
U = np.uint64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CLASS = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _CLASS[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = _c + 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return (np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, inverse)))


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``WORK_BYTES`` that part no word."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + WORK_BYTES, n)
        while b < n:
            gap = np.flatnonzero(_CLASS[data[b : b + WORK_BYTES]] == 0)
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + WORK_BYTES, n)
        yield a, b
        a = b


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece; ``bounds`` are text bounds in it, which part words too."""
    code = _CLASS[data]
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = code > 0
    step = word[1:] != word[:-1]
    step[bounds] = word[bounds] | word[bounds + 1]
    starts, ends = np.flatnonzero(step[:-1] & word[1:-1]), np.flatnonzero(step & word[:-1])
    power, inverse = _powers(1 << max(16, len(data).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(code.astype(U) * power[: len(data)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * _MULT), starts


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text and the text each belongs to.

    ``data`` holds UTF-8 bytes, ``offsets`` the texts' bounds. Words are runs of ASCII letters, digits and underscores
    in lower case. A word's hash is a polynomial in its bytes, taken from prefix sums over pieces of bounded size.
    """
    found = []
    for a, b in _segments(data):
        h, starts = _words(data[a:b], offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a)
        found.append((h, starts + a))
    h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, U)
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    text = np.searchsorted(offsets, np.concatenate([f[1] for f in found]), side="right") - 1
    n = len(h) - k + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out = _mix(out * _MULT + h[j : j + n])
    same = text[:n] == text[k - 1 :]
    return out[same], text[:n][same]


def row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``WORK_BYTES`` of text, one row at least, to bound the arrays made from it."""
    sizes = sum(np.diff(np.frombuffer((c := batch.column(i).cast(pa.large_binary()).fill_null(b"")).buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]) for i in range(1, batch.num_columns))
    group = (np.cumsum(sizes) // WORK_BYTES) if batch.num_rows else np.zeros(0)
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of an Arrow string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _sets(columns: Sequence[pa.Array], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row over all its fields, sorted, and the rows' bounds."""
    found = [shingle_hashes(*_bytes_of(c), k) for c in columns]
    h, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[first], row[first]
    return h, np.searchsorted(row, np.arange(len(columns[0]) + 1))


@lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    return _mix(np.arange(1, SLOTS + 1, dtype=U) * _MULT)


def _coder(k: int):
    """(id, field...) -> (id, n, d1, d2, code, set): class digest, sketch and shingle set of each record with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_slices(whole)):
            h, bounds = _sets(batch.columns[1:], k)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            at = bounds[:-1][some]
            if not len(some):
                continue
            with np.errstate(over="ignore"):
                digests = [np.add.reduceat(_mix(h ^ s), at) for s in (U(0x1234567), U(0xABCDEF987))]
                code = np.empty((len(some), SLOTS), np.uint32)
                for j, s in enumerate(_seeds()):
                    code[:, j] = np.minimum.reduceat(_mix(h ^ s), at) >> U(32)
            code_col = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * 4 * SLOTS).astype(np.int32)), pa.py_buffer(code.tobytes())])
            sets = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some].astype(np.int32)), *(pa.array(d.view(np.int64)) for d in digests), code_col, sets], ["id", "n", "d1", "d2", "code", "set"])

    return run


def coded(df: DataFrame, item: str, fields: Sequence[str], k: int) -> DataFrame:
    """(``id``, ``n``, ``d1``, ``d2``, ``code``, ``set``) of the records that have at least one run of ``k`` words."""
    slim = df.select(F.col(item).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    return slim.mapInArrow(_coder(k), "id long, n int, d1 long, d2 long, code binary, set array<long>")


def _codes(column: pa.Array) -> np.ndarray:
    data, _ = _bytes_of(column)
    return data.view(np.uint32).reshape(-1, SLOTS)


def _subsets(threshold: int) -> list[tuple[int, ...]]:
    return list(combinations(range(PARTITION), PARTITION - threshold)) if threshold >= 0 else []


def _signatures(codes: np.ndarray, slots: Sequence[int], threshold: int, salt: int) -> list[np.ndarray]:
    """One column of signatures for each subset of the partition's slots that must agree."""
    out = []
    with np.errstate(over="ignore"):
        for j, keep in enumerate(_subsets(threshold)):
            x = np.full(len(codes), U(salt * 64 + threshold * 16 + j + 1))
            for p in keep:
                x = _mix(x * _MULT + codes[:, slots[p]].astype(U) + U(p + 1))
            out.append(x)
    return out


def _joint(codes: np.ndarray, i: int, j: int) -> np.ndarray:
    return _mix(codes[:, i].astype(U) << U(32) | codes[:, j].astype(U))


def _counter(groups: Sequence[Sequence[int]], buckets: int):
    """codes -> (kind, part, counts): hashed counts, of the joint values of each two slots (a slot and itself included), or of
    each partition's signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = _codes(batch.column(0))
            if groups:
                columns = ((i * 64 + t * 16 + j, x) for i, slots in enumerate(groups) for t in range(PARTITION) for j, x in enumerate(_signatures(codes, slots, t, i)))
            else:
                columns = ((i * SLOTS + j, _joint(codes, i, j)) for i in range(SLOTS) for j in range(i, SLOTS))
            for kind, x in columns:
                total[kind] = total.get(kind, 0) + np.bincount((x % U(buckets)).astype(np.int64), minlength=buckets)
        yield _vectors(list(total), total.values())

    return run


def _vectors(kinds: Sequence[int], counts: Iterable[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([v.astype("<i8").tobytes() for v in counts], pa.binary())], ["kind", "counts"])


def _added(table: pa.Table) -> pa.Table:
    """One vector for the vectors of a kind."""
    v = reduce(np.add, (np.frombuffer(b.as_py(), "<i8") for b in table.column("counts")))
    return pa.Table.from_batches([_vectors(table.column("kind").to_pylist()[:1], [v])])


def summed(counts: DataFrame) -> DataFrame:
    """One row (``kind``, ``counts``) for each kind: the sum of its vectors, one of each task before.

    The vectors are added up in two levels: those of ``FAN_IN`` tasks at a time first, so no group holds those of all tasks.
    """
    near = counts.withColumn("part", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("kind", "part").applyInArrow(_added, "kind int, counts binary")
    return near.groupBy("kind").applyInArrow(_added, "kind int, counts binary")


def _excess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that fall together beyond those expected of an even spread over the buckets."""
    for batch in batches:
        v = [np.frombuffer(b.as_py(), "<i8").astype(float) for b in batch.column(1)]
        excess = [max(float((x**2).sum() - x.sum() ** 2 / len(x) - x.sum()), 0.0) / 2 for x in v]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(excess, pa.float64())], ["kind", "excess"])


def _candidates(codes: DataFrame, groups: Sequence[Sequence[int]]) -> dict[int, float]:
    """Estimated chance pairs by kind, over all codes; one number for each kind comes to the driver."""
    counts = codes.select("code").mapInArrow(_counter(groups, BUCKETS if groups else JOINT_BUCKETS), "kind int, counts binary")
    return {r["kind"]: r["excess"] for r in summed(counts).mapInArrow(_excess, "kind int, excess double").collect()}


def correlated(both: dict[int, float]) -> list[list[int]]:
    """Partitions of slots that agree in the same pairs; ``both[i * SLOTS + j]`` is how often slots i <= j agree together.

    From the slot that agrees most often on, each partition takes the slots whose agreement is most like that of the
    slots it has, by the cosine of the two.
    """
    often = lambda i, j: both.get(min(i, j) * SLOTS + max(i, j), 0.0)
    alike = lambda i, j: often(i, j) / (often(i, i) * often(j, j)) ** 0.5 if often(i, i) and often(j, j) else 0.0
    left, groups = set(range(SLOTS)), []
    while left:
        group = [max(left, key=lambda i: (often(i, i), -i))]
        left -= set(group)
        while len(group) < PARTITION:
            group.append(max(left, key=lambda j: (sum(alike(i, j) for i in group), -j)))
            left.discard(group[-1])
        groups.append(group)
    return groups


def missed(thresholds: Sequence[int], percent: int) -> float:
    """The chance that two records of similarity ``percent`` meet in no partition: more than T_i slots differ in each."""
    same = percent / 100
    differ = lambda t: sum(comb(PARTITION, d) * (1 - same) ** d * same ** (PARTITION - d) for d in range(t + 1, PARTITION + 1))
    return reduce(lambda x, t: x * differ(t), thresholds, 1.0)


def allocate(cost: Sequence[Sequence[float]], need: int) -> list[int]:
    """Thresholds T_i >= -1 with sum of (T_i + 1) >= ``need`` at least total cost; cost[i][t] is that of T_i = t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for have, (spent, chosen) in best.items():
            for t in range(-1, len(row)):
                key, total = min(have + t + 1, need), spent + (row[t] if t >= 0 else 0.0)
                if key not in new or total < new[key][0]:
                    new[key] = (total, [*chosen, t])
        best = new
    return best[need][1]


def plan(codes: DataFrame, rows: int, percent: int) -> tuple[list[list[int]], list[int]]:
    """The partitions of the slots and their thresholds."""
    groups = correlated(_candidates(codes, ()))
    estimate = _candidates(codes, groups)
    probes = [comb(PARTITION, t) for t in range(PARTITION)]
    cost = [[rows * probes[t] + sum(estimate.get(i * 64 + t * 16 + j, 0.0) for j in range(probes[t])) for t in range(PARTITION)] for i in range(len(groups))]
    for most_different in range(SLOTS):
        thresholds = allocate(cost, most_different + 1)
        if missed(thresholds, percent) <= LOSS:
            break
    return groups, thresholds


def _prober(groups: Sequence[Sequence[int]], thresholds: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch.column(2))
            columns = [x for i, (slots, t) in enumerate(zip(groups, thresholds, strict=True)) for x in _signatures(codes, slots, t, i)]
            ids, n = (np.tile(batch.column(i).to_numpy(), len(columns)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns).view(np.int64)), pa.array(ids), pa.array(n)], ["sig", "id", "n"])

    return run


def _close(n1: Column, n2: Column, percent: int) -> Column:
    """The sizes of two sets do not rule the similarity out."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _flat_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes, shingles one set behind the other) of batches (id, set), in pieces of about ``WORK_BYTES``."""
    for batch in batches:
        ids, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        piece = np.cumsum(n.astype(np.int64) * 8) // WORK_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield ids[a:b], n[a:b], batch.column(1).slice(int(a), int(b - a)).flatten().to_numpy(zero_copy_only=False).view(U)


def _place(h: np.ndarray) -> np.ndarray:
    return (_mix(h) % U(BUCKETS * RANK_PARTS)).astype(np.int64)


def _shingle_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * RANK_PARTS, np.int64)
    for _, _, h in _flat_sets(batches):
        total += np.bincount(_place(h), minlength=len(total))
    yield _vectors(range(RANK_PARTS), total.reshape(RANK_PARTS, BUCKETS))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranks = [(6 * np.log2(1 + np.frombuffer(b.as_py(), "<i8").astype(float))).astype(np.uint8).tobytes() for b in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranks, pa.binary())], ["kind", "ranks"])


def _prefixer(ranks: bytes, percent: int):
    """(id, set) -> (x, id, n, p): the rarest shingles of each set, of which two similar sets share one, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks, np.uint8)
        for ids, n, h in _flat_sets(batches):
            row = np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((h, rank[_place(h)], row))]
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            keep = place < (n - (n.astype(np.int64) * percent + 99) // 100 + 1)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(ids[row[keep]]), pa.array(n[row[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32))], ["x", "id", "n", "p"])

    return run


def with_counts(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` has more than one row, with the number ``c`` of its rows.

    Counts combine on the map side and are joined back, and the join splits a hot key, so its rows never meet in one task.
    """
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1"), key)


def exact_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``), a < b, maybe repeated: a superset of all pairs of ``sets`` (id, set) with the similarity.

    Prefix filter: with the shingles of all sets in one order, rare ones first, two sets of n shingles and at least the
    similarity share one of their first n - ceil(n * similarity) + 1. The order is by hashed counts, which decide on
    the speed only. Shingles with many sets are salted, so about ``HOT`` of them at a time meet the rest.
    """
    counts = summed(sets.mapInArrow(_shingle_counter, "kind int, counts binary")).mapInArrow(_ranked, "kind int, ranks binary")
    ranks = b"".join(bytes(r["ranks"]) for r in sorted(counts.collect(), key=lambda r: r["kind"]))
    first = sets.mapInArrow(_prefixer(ranks, percent), "x long, id long, n int, p int")
    first = materialize(with_counts(first, "x").withColumn("salts", F.ceil(F.col("c") / HOT).cast("int")), "prefixes")
    left = first.select("x", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    right = first.select("x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    # at the first shingle that both have, the sets cannot have more in common than the shorter rest
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")).cast("long") * (100 + percent) >= (F.col("na") + F.col("nb")).cast("long") * percent
    return left.join(right, ["x", "salt"]).where((F.col("a") < F.col("b")) & _close(F.col("na"), F.col("nb"), percent) & rest).select("a", "b")


def candidate_pairs(codes: DataFrame, rows: int, percent: int) -> DataFrame:
    """(``a``, ``b``), a < b, once each: classes that meet in a signature, as far as their sets can be similar.

    ``codes`` has ``id``, ``n``, ``code`` and ``set``. A signature with more than ``HOT`` classes is boilerplate or a
    large group; instead of pairing all of them, all similar pairs of classes in hot signatures are found on their
    exact sets (:func:`exact_pairs`), so one shared signature is enough for a pair whatever its size.
    """
    groups, thresholds = plan(codes, rows, percent)
    probes = codes.select("id", "n", "code").mapInArrow(_prober(groups, thresholds), "sig long, id long, n int")
    counted = materialize(with_counts(probes, "sig"), "signatures")
    cool = counted.where(F.col("c") <= HOT)
    met = _pairs_within(cool, ["sig"], percent)
    if counted.where(F.col("c") > HOT).limit(1).count():
        hot = counted.where(F.col("c") > HOT).select("id").distinct()
        sets = materialize(codes.select("id", "set").join(hot, "id", "left_semi"), "hot-sets")
        met = met.unionByName(exact_pairs(sets, percent))
    return met.distinct()


def _pairs_within(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    left = rows.select(*keys, F.col("id").alias("a"), F.col("n").alias("na"))
    right = rows.select(*keys, F.col("id").alias("b"), F.col("n").alias("nb"))
    return left.join(right, keys).where((F.col("a") < F.col("b")) & _close(F.col("na"), F.col("nb"), percent)).select("a", "b")


class NearDuplicates:
    """Classes of equal records, and links between similar classes.

    ``item`` is a unique integer column. Records without a run of ``k`` words (null or short texts) are similar to
    nothing and do not come out. Similarity is the number of shingles in both sets divided by the number in either,
    compared as whole numbers: ``percent`` is inclusive. An empty table gives no rows. Other columns are not read.
    """

    def __init__(self, df: DataFrame, item: str, fields: Sequence[str], k: int = 5, percent: int = 80) -> None:
        self.percent = percent
        records = materialize(coded(df, item, fields, k), "codes")
        same = records.groupBy("d1", "d2").agg(F.min("id").alias("class"))
        #: (``class``, ``id``): every record and the least record with the same set
        self.members = records.select("id", "d1", "d2").join(same, ["d1", "d2"]).select("class", "id")
        self.members = materialize(self.members, "members")
        self.classes = records.join(self.members.where("class = id").select("id"), "id", "left_semi")

    def links(self) -> DataFrame:
        """(``a``, ``b``, ``common``, ``either``): similar classes, a < b."""
        rows = self.members.where("class = id").count()
        pairs = materialize(candidate_pairs(self.classes.select("id", "n", "code", "set"), rows, self.percent), "pairs")
        used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = self.classes.select("id", "set").join(used, "id", "left_semi")
        with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
        return common.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("either")).where(F.col("common") * 100 >= F.col("either") * self.percent)

    def pairs(self) -> DataFrame:
        """(``a``, ``b``), a < b: all similar pairs of records, those of equal records included."""
        m = self.members
        between = self.links().select(F.col("a").alias("ca"), F.col("b").alias("cb"))
        left, right = m.select(F.col("class").alias("ca"), F.col("id").alias("x")), m.select(F.col("class").alias("cb"), F.col("id").alias("y"))
        across = between.join(left, "ca").join(right, "cb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        again = m.where("class <> id").select("class").distinct()
        multiple = m.join(again, "class", "left_semi")
        inside = multiple.select("class", F.col("id").alias("a")).join(multiple.select("class", F.col("id").alias("b")), "class").where("a < b").select("a", "b")
        return across.unionByName(inside)

    def groups(self) -> DataFrame:
        """(``id``, ``class``, ``group``, ``links``): every record with its class, the least record of its connected
        group, and the number of classes that its class is similar to."""
        links = materialize(self.links().select("a", "b"), "links")
        roots = components(links, "a", "b").withColumnRenamed("node", "class")
        degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
        return self.members.join(roots, "class", "left").join(degree, "class", "left").select("id", "class", F.coalesce("root", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


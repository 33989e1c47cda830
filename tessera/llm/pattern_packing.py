"""Operator 12: packing by patterns of lengths.

What is packed is a histogram: pieces of one length are exchangeable, so a plan for lengths packs any number of them. Patterns of up
to four lengths that fill a sequence exactly are enumerated, and non-negative least squares fit how often each is used, so that
together they use up the histogram. The counts are rounded so that no length is used more than it occurs, and the
rest is packed by best fit, again length by length: the longest left, then the longest that fits its gap, as often as all
of them last. The plan is a table of slots: so many pieces of a length, from this rank on, lie in these sequences at this place.

Texts are encoded where they are read, once. Pieces get their rank within their length from a running count in their task and
the counts of the tasks before it, and find their slot by binary search. Histogram and plan are bounded by the capacity,
whatever the number of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .token_store import json_encoder

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 0, 2048
#: One triple of lengths in so many is a pattern, and one quadruple in the product of both, chosen so that every length has its share.
THIN_TRIPLES, THIN_QUADRUPLES = 16, 64
STEPS = 600
POWER = 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Rows of one to four lengths, longest first and zero where there is none, that add up to capacity; lengths with present[length] only."""
    lengths = np.flatnonzero(present[: capacity + 1])
    lengths = lengths[lengths > 0]
    found = [np.array([[capacity, 0, 0, 0]])]

    def keep(*columns):
        x = np.stack([*columns, *[np.zeros_like(columns[0])] * (4 - len(columns))], 1)
        good = np.ones(len(x), bool)
        for i, c in enumerate(columns):
            good &= (c > 0) & present[np.maximum(c, 0)] & (c <= (columns[i - 1] if i else capacity))
        found.append(x[good])

    keep(lengths, capacity - lengths)
    for a in lengths:
        b = lengths[(lengths <= a) & (lengths >= (capacity - a) / 3) & ((a + 5 * lengths) % THIN_TRIPLES == 0)]
        a_s = np.full(len(b), a)
        keep(a_s, b, capacity - a - b)
        c = (np.arange(0, capacity, THIN_QUADRUPLES)[None, :] + ((3 * a + 7 * b) % THIN_QUADRUPLES)[:, None]).ravel()
        a_s, b = np.full(len(c), a), np.repeat(b, -(-capacity // THIN_QUADRUPLES))
        keep(a_s, b, c, capacity - a - b - c)
    every = np.concatenate(found)
    return every[present[every[:, 0]]]


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each pattern, as real numbers: min |W (counts - A x)| for x >= 0, by accelerated projected gradients.

    W is the length: short pieces that are left over still fit gaps, long ones do not.
    """
    if not len(rows):
        return np.zeros(0)
    bins, valid = len(counts), (rows > 0).astype(float)
    weights = (np.arange(bins) / (bins - 1)) ** POWER

    def used(x):
        return np.bincount(rows.ravel(), (valid * x[:, None]).ravel(), bins)

    def slopes(r):
        return (r[rows] * valid).sum(1)

    probe = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue of A'A bounds the step
        probe = slopes(weights * used(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, y + slopes(weights * (counts - used(y))) / (1.05 * size))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = after + (t - 1) / t2 * (after - x)
        x, t = after, t2
    return x


def _rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Whole numbers of patterns, the most used first, that `left` allows; it is what stays."""
    plan = []
    for i in np.argsort(-x, kind="stable")[: int((x >= 0.5).sum())].tolist():
        sizes, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = int(min(np.rint(x[i]), (left[sizes] // times).min()))
        if n > 0:
            left[sizes] -= n * times
            plan.append((n, [*zip(sizes[::-1].tolist(), times[::-1].tolist(), strict=True)]))
    return plan


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns that use up a histogram: the longest, then the longest that fits. Each uses up a length at least."""
    left, plan = left.copy(), []
    lengths = np.flatnonzero(left).tolist()
    while lengths:
        gap, parts, at = capacity, [], len(lengths)
        while gap and (at := bisect_right(lengths, gap, hi=at)):
            size = lengths[at - 1]
            times = min(gap // size, int(left[size]))
            parts.append((size, times))
            gap, at = gap - size * times, at - 1
        n = min(int(left[size]) // times for size, times in parts)
        for size, times in parts:
            left[size] -= n * times
        lengths = [x for x in lengths if left[x]]
        plan.append((n, parts))
    return plan


def plan_slots(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slots of a histogram, sorted by length and first rank: length, first, sequence, repeats, offset.

    The j-th piece of a slot lies in sequence + j % repeats at offset + j // repeats * length. Sequences are numbered from 0 without gaps.
    """
    left, slots, base = counts.copy(), [], 0
    rows = patterns(capacity, counts > 0)
    plan = _rounded(rows, fit(rows, counts.astype(float)), left)
    used = np.zeros(len(counts), np.int64)
    for n, parts in plan + best_fit(left, capacity):
        offset = 0
        for size, times in parts:
            slots.append((size, int(used[size]), base, n, offset))
            used[size] += n * times
            offset += size * times
        base += n
    return dict(zip(("length", "first", "sequence", "repeats", "offset"), np.array(sorted(slots), np.int64).reshape(-1, 5).T, strict=True))


def _pieces(batches, tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    encoder, part, seen = json_encoder(tokenizer, spaced=False), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch, ids, ends in encoder.encode_batches(batches):
        ids, ends = np.insert(ids, ends[1:], end_id).astype("<u4", copy=False), ends + np.arange(len(ends))
        sizes = np.diff(ends)
        n = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, sizes[doc] - start)
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        rank = np.empty(len(doc), np.int64)
        rank[order] = seen[ordered] + np.arange(len(doc)) - np.searchsorted(ordered, ordered)
        seen += np.bincount(length, minlength=capacity + 1)
        at = (ends[:-1][doc] + start).tolist()
        cuts = [ids[a : a + k] for a, k in zip(at, length.tolist(), strict=True)]
        columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(np.full(len(doc), part, np.int64)), pa.array(rank)]
        names = [f.split()[0] for f in _PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays(columns + [pa.array([c.view("<i4") for c in cuts], pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)


def _placed(batches, slots: dict[str, np.ndarray]):
    keys = slots["length"] << 44 | slots["first"]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        slot = np.searchsorted(keys, length << 44 | rank, "right") - 1
        j, repeats = rank - slots["first"][slot], slots["repeats"][slot]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(slots["sequence"][slot] + j % repeats), pa.array(slots["offset"][slot] + j // repeats * length)], names=[*batch.schema.names, "sequence_id", "offset"]
        )


def pack_patterns(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, unless with_ids is False, the piece's ids.

    Only documents longer than capacity are cut, into pieces of capacity and a last one. A null or empty text has only the end id. Null and repeated
    doc_ids are documents like any other; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, capacity, with_ids), _PIECES + ", ids array<int>" * with_ids), "pieces", compression="zstd")
    parts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length: capacity at most
        counts[r.length] = r.n
    slots = plan_slots(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(parts.select("length", "part", before.alias("before")), ["length", "part"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lambda it: _placed(it, slots), schema).drop("rank")


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_patterns(table(spark, sf_dir, "documents"), with_ids=False)

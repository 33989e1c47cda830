"""Operator 9: hierarchical multi-length packing.

Each task packs the documents it reads, without a shuffle. A document's ids are cut into whole windows of the longest
context; the rest goes to the tier of the shortest context that holds it. Tiers are packed from the longest down: a
sequence starts with the tier's largest piece, its gap takes the largest fitting pieces of this and shorter tiers, and what gap
is left takes a piece cut to measure, so every sequence is full. When a task's last pieces cannot fill a context, they
form sequences of the powers of two they add up to, which need no padding either. Sequences are dealt to the lightest of a few
open step groups, so that the steps of a training run carry equal numbers of tokens.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .token_store import json_encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CONTEXTS = (256, 512, 1024, 2048)
#: Ids that a task holds before it packs them; its memory does not grow with its input.
BUFFER_TOKENS = 2_000_000
#: Step groups: so many open at a time, each closed at so many tokens.
OPEN_GROUPS, GROUP_TOKENS = 4, 16 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class Packer:
    """Packs pieces (length, key, start, ids as uint32 bytes) of one task; key is (doc_id, doc_tokens)."""

    def __init__(self, contexts=CONTEXTS, task: int = 0):
        self.contexts, self.tiers, self.held = tuple(sorted(contexts)), {c: [] for c in sorted(contexts)}, 0
        self.base, self.made, self.groups, self.next_group, self.order, self.rows = task << 32, 0, [], 0, 0, []

    def _route(self, length: int, key, start: int, ids: bytes) -> None:
        tier = next(c for c in self.contexts if length <= c)
        self.order += 1  # a total order, so that keys are never compared
        insort(self.tiers[tier], (length, self.order, key, start, ids))
        self.held += length

    def add(self, doc_id, ids: bytes) -> None:
        total, top = len(ids) // 4, self.contexts[-1]
        key, start = (doc_id, total), 0
        while total - start >= top:
            self._emit([(top, key, start, ids[4 * start : 4 * (start + top)])])
            start += top
        if start < total:
            self._route(total - start, key, start, ids[4 * start :])

    def _take(self, tier: int, i: int):
        length, _, key, start, ids = self.tiers[tier].pop(i)
        self.held -= length
        return length, key, start, ids

    def _fill(self, size: int) -> None:
        """One sequence of exactly size ids; at least so many are held."""
        parts, gap = [], size
        while gap:
            fitting = [(self.tiers[c][i - 1][0], c, i - 1) for c in self.contexts if (i := bisect_right(self.tiers[c], gap, key=lambda x: x[0]))]
            if fitting:
                _, tier, i = max(fitting)
                parts.append(self._take(tier, i))
            else:  # cut a piece of the shortest tier to measure
                tier = next(c for c in self.contexts if self.tiers[c])
                length, key, start, ids = self._take(tier, 0)
                parts.append((gap, key, start, ids[: 4 * gap]))
                self._route(length - gap, key, start + gap, ids[4 * gap :])
            gap -= parts[-1][0]
        self._emit(parts)

    def _emit(self, parts) -> None:
        size = sum(p[0] for p in parts)
        if len(self.groups) < OPEN_GROUPS:
            self.groups.append((0, self.base + self.next_group))
            self.next_group += 1
            heapq.heapify(self.groups)
        tokens, group = heapq.heappop(self.groups)
        if tokens + size < GROUP_TOKENS:
            heapq.heappush(self.groups, (tokens + size, group))
        offset = 0
        for length, (doc_id, total), start, ids in parts:
            self.rows.append((doc_id, start, length, ids, total, self.base + self.made, offset, size, group))
            offset += length
        self.made += 1

    def pack(self, last: bool = False):
        for size in reversed(self.contexts):
            while self.tiers[size] and self.held >= size:
                self._fill(size)
        while last and self.held:
            self._fill(1 << (self.held.bit_length() - 1))
        rows, self.rows = self.rows, []
        return rows


def _pack(batches, tokenizer: str, end_id: int, contexts, with_ids: bool):
    encoder, end = json_encoder(tokenizer, spaced=False), np.array([end_id], "<u4").tobytes()
    packer = Packer(contexts, TaskContext.get().partitionId())

    def out(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 9
        arrays = [pa.array(c, pa.int64()) for c in (*cols[:3], [zlib.crc32(x) for x in cols[3]], *cols[4:])]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<i4") for x in cols[3]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

    for batch, flat, ends in encoder.encode_batches(batches):
        raw = flat.astype("<u4", copy=False).tobytes()
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            packer.add(doc_id, raw[4 * a : 4 * b] + end)
            if packer.held >= BUFFER_TOKENS:
                yield out(packer.pack())
        if len(packer.rows) >= 1000:
            yield out(packer.rows)
            packer.rows = []
    yield out(packer.pack(last=True))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, contexts=CONTEXTS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences: SCHEMA and, unless with_ids is False, the piece's ids.

    A null or empty text has only the end id. Null and repeated doc_ids are documents like any other. Each id lies in
    exactly one piece. Sequence and group ids hold the task's number in their upper bits, so a task that runs again makes
    the same ones. An empty table gives no rows; other columns are not read.
    """
    if any(c & (c - 1) for c in contexts):
        raise ValueError("contexts must be powers of two")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer, end_id, tuple(contexts), with_ids), SCHEMA + ", ids array<int>" * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)

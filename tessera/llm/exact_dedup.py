"""Operator 4: exact dedup by Patricia tries that own partitions of (length, content hash).

1. Each task that reads documents inserts their normalised bytes into a trie of its own and keeps one row for each distinct
   text: the best original row, how many rows had it, and their ids. A text that a third of all rows repeat leaves a task
   as one row for each LOCAL_BYTES that the task reads.
2. These rows are dealt by length and content hash; the task that owns a partition inserts the full byte strings into a compressed
   radix trie, whose terminal nodes keep the best row and the smallest identifier. Beyond a bound, which counts labels and whole rows, the heaviest
   subtree below the first branching node is spilled to a file of the task (in Spark's local folder, as a shuffle spills; at most
   the partition's bytes, and a task that runs again writes its own) and finished later by itself, without the prefix its strings share.
3. For survivors the owner sends on the rows that stay: rows are shuffled once and nothing is joined. For decisions the short rows of
   step 1 are written, and verdicts are joined to them by number.

White space is [\\x20\\x09-\\x0D]. Null texts count as empty. Of equal texts the row with the most code points stays, then the
one with the smallest id (null ids last), then the one read first, so exactly one of repeated rows stays. An empty table gives
empty results; other columns are carried as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, small_batches, table, written

WHITE_SPACE = b" \t\n\v\f\r"
#: Bytes of rows and labels that a reading task holds before it sends on what it has, and that an owner holds before it spills.
LOCAL_BYTES, OWNER_BYTES = 48 << 20, 128 << 20
#: What a node of a trie takes besides its label (its list, children and value), and an id that is kept for a row.
NODE_BYTES, ID_BYTES = 600, 48


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE_SPACE)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings. A node is [label, children by first byte, value of the string that ends here]."""

    def __init__(self):
        self.root, self.held = [b"", {}, None], 0

    def insert(self, key: bytes, value, better) -> object:
        """Put value under key, or better(old, value) if key is there; the terminal's value is returned."""
        node = self.root
        while True:
            label, children, _ = node
            if not key:
                break
            child = children.get(key[0])
            if child is None:
                children[key[0]] = node = [key, {}, None]
                self.held += len(key) + NODE_BYTES
                break
            if key.startswith(child[0]):
                key, node = key[len(child[0]) :], child
                continue
            n = _common(key, child[0])
            children[key[0]] = node = [child[0][:n], {child[0][n]: child}, None]
            child[0], key = child[0][n:], key[n:]
            self.held += NODE_BYTES
            if key:
                node[1][key[0]] = leaf = [key, {}, None]
                self.held += len(key) + NODE_BYTES
                node = leaf
            break
        node[2] = value if node[2] is None else better(node[2], value)
        return node[2]

    def heaviest(self) -> bytes | None:
        """The prefix of the subtree with the most bytes, of those below the first node where strings part or one ends. None
        where a single string is left."""
        path, node = b"", self.root
        while len(node[1]) == 1 and node[2] is None:
            (node,) = node[1].values()
            path += node[0]
        if not node[1]:
            return None
        return path + bytes([max(node[1], key=lambda b: sum(len(n[0]) + NODE_BYTES for n in self._nodes(node[1][b])))])

    def _nodes(self, node):
        stack = [node]
        while stack:
            yield (node := stack.pop())
            stack.extend(node[1].values())

    def pop(self, prefix: bytes) -> list:
        """Remove the subtree that heaviest() named: the values of its strings."""
        node = self.root
        while len(prefix) > 1:
            node = node[1][prefix[0]]
            prefix = prefix[len(node[0]) :]
        gone = list(self._nodes(node[1].pop(prefix[0])))
        self.held -= sum(len(n[0]) + NODE_BYTES for n in gone)
        return [n[2] for n in gone if n[2] is not None]

    def values(self) -> list:
        return [n[2] for n in self._nodes(self.root) if n[2] is not None]


def _merge(a: list, b: list) -> list:
    """Values are [order, place of the row, number of rows, their reps]."""
    first = a if a[0] <= b[0] else b
    if a[3] is not None:
        a[3].extend(b[3])
    return [first[0], first[1], a[2] + b[2], a[3]]


class Owner:
    """The trie of one partition. Rows stay in Arrow batches, with the columns rep, `id_col` and `text_col`; members: whether the reps of
    all rows of a text are kept, or the best row only."""

    def __init__(self, id_col: str, text_col: str, members: bool, limit: int = OWNER_BYTES, skip: int = 0):
        self.id_col, self.text_col, self.members, self.limit, self.skip = id_col, text_col, members, limit, skip
        self.trie, self.batches, self.count, self.bytes, self.spilled = PatriciaTrie(), [], 0, 0, {}

    def add(self, batch: pa.RecordBatch, counts: list[int], reps: list | None = None) -> None:
        aside: dict[bytes, list[int]] = {}
        sizes = sorted({len(p) for p in self.spilled})
        columns = (batch.column(c).to_pylist() for c in (self.text_col, self.id_col, "rep"))
        values = []
        for i, (text, doc_id, rep) in enumerate(zip(*columns, strict=True)):
            key = normalised(text)[self.skip :]
            mine = (reps[i] if reps else array("q", [rep])) if self.members else None
            values.append([(-len(text or ""), doc_id is None, doc_id or 0, rep), self.count + i, counts[i], mine])
            if prefix := next((key[:n] for n in sizes if key[:n] in self.spilled), None):
                aside.setdefault(prefix, []).append(i)
            else:
                self.trie.insert(key, values[i], _merge)
        self.batches.append(batch)
        self.count += len(batch)
        self.bytes += batch.nbytes
        for prefix, at in aside.items():
            self._write(prefix, batch.take(pa.array(at)), [values[i] for i in at])
        if self.bytes + self.trie.held > self.limit:
            self._shrink()

    def _rows(self, values: list) -> pa.RecordBatch:
        rows = pa.Table.from_batches(self.batches).take(pa.array([v[1] for v in values], pa.int64())).combine_chunks()
        return rows.to_batches()[0]

    def _compact(self) -> None:
        if values := self.trie.values():
            self.batches, self.count = [self._rows(values)], len(values)
            for i, v in enumerate(values):
                v[1] = i
        else:
            self.batches, self.count = [], 0
        self.bytes = sum(b.nbytes for b in self.batches)

    def _shrink(self) -> None:
        """Let go of rows that are not best; spill subtrees until half of the bound is free again."""
        self._compact()
        while self.bytes + self.trie.held > self.limit // 2 and (prefix := self.trie.heaviest()):
            values = self.trie.pop(prefix)
            rows = self._rows(values)
            self._write(prefix, rows, values)
            self.bytes -= rows.nbytes
        self._compact()

    def _write(self, prefix: bytes, rows: pa.RecordBatch, values: list) -> None:
        about = {"__n": pa.array([v[2] for v in values], pa.int64()), "__reps": pa.array([v[3] for v in values], pa.list_(pa.int64()))}
        rows = pa.RecordBatch.from_arrays([*rows.columns, *about.values()], names=[*rows.schema.names, *about])
        if prefix not in self.spilled:
            out = tempfile.TemporaryFile(prefix="trie-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            self.spilled[prefix] = out, pa.ipc.new_stream(out, rows.schema)
        self.spilled[prefix][1].write_batch(rows)

    def groups(self, size: int = 512):
        """(best rows, numbers of rows, reps) of all distinct texts, some at a time."""
        values = self.trie.values()
        for i in range(0, len(values), size):
            part = values[i : i + size]
            yield self._rows(part), [v[2] for v in part], [v[3] for v in part]
        self.trie, self.batches = PatriciaTrie(), []
        for prefix, (out, writer) in self.spilled.items():
            writer.close()
            out.seek(0)
            below = Owner(self.id_col, self.text_col, self.members, self.limit, self.skip + len(prefix))
            for batch in pa.ipc.open_stream(out):
                reps = [array("q", r) for r in batch.column("__reps").to_pylist()] if self.members else None
                below.add(batch.select(batch.schema.names[:-2]), batch.column("__n").to_pylist(), reps)
            out.close()
            yield from below.groups(size)


def _local(batches, id_col: str, text_col: str, members: bool):
    """One row for each distinct text of a task; sent on when the rows held reach a bound (a text may then have two)."""
    task, made = TaskContext.get().partitionId(), 0

    def better(a, b):  # values are [order and place of the best row, ids of all rows, the best one's place in them]; a stays and grows
        if b[0] < a[0]:
            a[0], a[1], a[3] = b[0], b[1], len(a[2])
        a[2].extend(b[2])
        return a

    def flush(trie, held):
        nonlocal made
        rows = pa.Table.from_batches(held)
        found = trie.values()
        for i in range(0, len(found), 512):
            part = found[i : i + 512]
            keys = [normalised(t) for t in rows.column(text_col).take(pa.array([v[1] for v in part])).to_pylist()]
            digests = [hashlib.sha256(k).digest() for k in keys]
            more = {"rep": pa.array(range(task << 32 | made, (task << 32 | made) + len(part)), pa.int64()), "n_bytes": pa.array(map(len, keys), pa.int64()), "h": pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], pa.int64())}
            if members:
                more |= {"digest": pa.array(digests, pa.binary()), "ids": pa.array([v[2] for v in part], pa.list_(pa.int64())), "best": pa.array([v[3] for v in part], pa.int32())}
            made += len(part)
            (own,) = rows.take(pa.array([v[1] for v in part])).combine_chunks().to_batches()
            yield pa.RecordBatch.from_arrays([*own.columns, *more.values()], names=[*own.schema.names, *more])

    trie, held, count, size = PatriciaTrie(), [], 0, 0
    for batch in batches:
        for i, (text, doc_id) in enumerate(zip(batch.column(text_col).to_pylist(), batch.column(id_col).to_pylist(), strict=True)):
            order = (-len(text or ""), doc_id is None, doc_id or 0)
            trie.insert(normalised(text), [order, count + i, [doc_id] if members else [], 0], better)
        held.append(batch)
        count, size = count + len(batch), size + batch.nbytes + members * ID_BYTES * len(batch)
        if size + trie.held > LOCAL_BYTES:
            yield from flush(trie, held)
            trie, held, count, size = PatriciaTrie(), [], 0, 0
    if held:
        yield from flush(trie, held)


def _verdicts(batches):
    owner = Owner("doc_id", "text", members=True)
    for batch in batches:
        owner.add(batch, batch.column("n").to_pylist())
    for rows, counts, reps in owner.groups():
        keep = list(zip(rows.column("rep").to_pylist(), rows.column("doc_id").to_pylist(), counts, strict=True))
        flat = [(r, *k) for k, mine in zip(keep, reps, strict=True) for r in mine]
        for i in range(0, len(flat), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat[i : i + 10_000], strict=True)], names=["rep", "keep_rep", "keep_id", "group_size"])


def _stay(batches, id_col: str, text_col: str, n_columns: int):
    owner = Owner(id_col, text_col, members=False)
    for batch in batches:
        owner.add(batch, [1] * len(batch))
    for rows, _, _ in owner.groups():
        yield rows.select(rows.schema.names[:n_columns])


def local_texts(docs: DataFrame, id_col: str, text_col: str, members: bool) -> DataFrame:
    """Step 1: the best row of each distinct text with rep, n_bytes and h (which deal it to an owner) and, with members, the text's digest, the ids of
    its rows and the best one's place in them."""
    small_batches(docs.sparkSession)
    fields = [*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("rep", "n_bytes", "h"))]
    if members:
        fields += [T.StructField("digest", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("best", T.IntegerType())]
    return docs.mapInArrow(lambda it: _local(it, id_col, text_col, members), T.StructType(fields))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs with doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = written(local_texts(plain, "doc_id", "text", True), "texts", compression="zstd")
    rows = texts.select("rep", F.size("ids").cast("long").alias("n"), "doc_id", "text", "n_bytes", "h").repartition(shuffle_partitions(docs.sparkSession), "n_bytes", "h")
    verdicts = written(rows.select("rep", "n", "doc_id", "text").mapInArrow(_verdicts, "rep long, keep_rep long, keep_id long, group_size long"), "verdicts")
    judged = texts.select("rep", "ids", "best", F.lower(F.hex("digest")).alias("text_sha256")).join(verdicts, "rep")
    judged = judged.select("rep", "keep_rep", "best", "keep_id", "group_size", "text_sha256", F.posexplode("ids").alias("at", "doc_id"))
    return judged.select("doc_id", "keep_id", "group_size", ((F.col("rep") == F.col("keep_rep")) & (F.col("at") == F.col("best"))).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    mine, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    rows = local_texts(plain, mine, text, False).repartition(shuffle_partitions(docs.sparkSession), "n_bytes", "h").drop("n_bytes", "h")
    return rows.mapInArrow(lambda it: _stay(it, mine, text, len(names)), plain.schema).toDF(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decisions(docs)


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), w AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY k) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(k) AS text_sha256 FROM w
"""

"""Operator 3: SimHash near-dedup by a binary-trie self-join.

Equal fingerprints are one trie leaf, so copies are grouped first. Node pairs of the trie are the rows of a frontier, (a, b, differing
bits): each level joins the children of a and the children of b, adds the bits in which they differ, and drops pairs over the budget k and
pairs of a node with itself that has one leaf. Two fingerprints within k bits agree in one of k + 1 parts of their bits; so there
are k + 1 tries, each of the fingerprints turned so that another part is on top, and each is entered at the nodes below its top part, where
no bit differs yet. This leaves out the pairs of upper nodes, which are many in a full trie, and loses no link.

The first levels go down few bits, so a node has 16 children there and a pair of nodes 256 pairs of children at most; below, where nodes have
few leaves, more bits. A node has few neighbours within k bits, so no key of a join grows with a group of near copies, and all
steps are joins and counts that Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, small_batches, table, temporary, written

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Bits that the levels of the traversal go down; the last number repeats.
STEPS = (4, 4, 5, 10)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A-Z lowered; words are runs without [\\x20\\x09-\\x0D]; shingles of `size` words, repeats included (fewer words: the whole
    sequence; none: 0). A bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return int.from_bytes(digest(b" ".join(words), seed), "big")
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-size]]
    hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(rows), 65536):
        counts += np.unpackbits(rows[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def _fingerprints(batches, size: int):
    for batch in batches:
        out = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(out)], names=["row_key", "doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """row_key, doc_id, fp (signed 64 bits); one row for each row of docs. row_key is docs' key_col, or, without one, the row's
    place in this one scan of docs, by which no other scan finds it. Null texts count as empty, repeated rows have a row each, an empty table gives no
    rows; other columns are not read, whatever their names."""
    small_batches(docs.sparkSession)
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    rows = docs.select(key.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, size), "row_key long, doc_id long, fp long")


def _prefix(name: str, depth: int) -> F.Column:
    return F.shiftrightunsigned(name, 64 - depth)


def near_links(fps: DataFrame, budget: int = MAX_BITS, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Distinct fp -> (a, b): all pairs of different fingerprints within `budget` bits, each once or more, in one order or the other.

    A frontier of node pairs (way, a, b, differing bits) of the binary trie goes down some bits at a time.
    """
    root = 64 // (budget + 1)
    turns = [64 * k // (budget + 1) for k in range(budget + 1)]
    turned = [F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp") for s in turns]
    leaves = fps.select(F.posexplode(F.array(*turned)).alias("way", "leaf")).withColumn("top", _prefix("leaf", root))
    pairs = leaves.groupBy("way", "top").agg(F.count("*").alias("n")).filter("n > 1")
    live = written(leaves.join(pairs.select("way", "top"), ["way", "top"]).drop("top"), "leaves")  # leaves whose top bits no other shares have no link
    pairs = pairs.select("way", F.col("top").alias("a"), F.col("top").alias("b"), F.lit(0).alias("errors"))
    depth = root
    while depth < 64:
        below = min(64, depth + (steps[0] if steps else 64))
        steps, bits = steps[1:] or steps[-1:], below - depth
        kids = live.groupBy("way", _prefix("leaf", depth).alias("node"), _prefix("leaf", below).alias("kid")).agg(F.count("*").alias("n"))
        left = kids.select("way", F.col("node").alias("a"), F.col("kid").alias("x"), F.col("n").alias("leaves"))
        right = kids.select("way", F.col("node").alias("b"), F.col("kid").alias("y"))
        differ = F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << bits) - 1)))
        pairs = pairs.join(left, ["way", "a"]).join(right, ["way", "b"]).filter("a <> b or x <= y").withColumn("errors", (F.col("errors") + differ).cast("int"))
        pairs = pairs.filter(F.col("errors") <= budget).filter("x <> y or leaves > 1").select("way", F.col("x").alias("a"), F.col("y").alias("b"), "errors")
        depth = below
    back = lambda c: F.coalesce(*[F.when(F.col("way") == k, F.shiftrightunsigned(c, s).bitwiseOR(F.shiftleft(c, 64 - s)) if s else F.col(c)) for k, s in enumerate(turns)])
    return pairs.filter("a <> b").select(back("a").alias("a"), back("b").alias("b"))


def simhash_components(fps: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """row_key, doc_id, fp -> the same rows with component_id (smallest doc_id reachable) and keeper (row_key of the one row
    that stays: the smallest of that doc_id's rows in the component). Rows with a null doc_id link like others but never name a component
    that has another; component_id is null only if a component has no doc_id."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")), "classes")
    links = near_links(classes.select("fp"), budget).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_components(links).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = classes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("keeper"))
    return fps.join(named, "fp")


def survivors(docs: DataFrame, size: int = SHINGLE_WORDS, budget: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows that stay, one for each component. Null texts count as empty, repeated rows are copies, an empty table gives an empty
    result; a column of docs called __row_key is an error. docs are written once with their row_key: a second scan of docs may be split in another way. Rows that go
    are named in a table, which Spark broadcasts where it is small enough by its setting; else the rows are shuffled once."""
    if "__row_key" in docs.columns:
        raise ValueError("docs have a column __row_key")
    rows = written(docs.withColumn("__row_key", F.monotonically_increasing_id()), "rows", compression="zstd")
    with temporary() as keep:
        fps = written(fingerprints(rows, size, id_col, text_col, "__row_key"), "fingerprints")
        gone = keep(written(simhash_components(fps, budget).filter("row_key <> keeper").select(F.col("row_key").alias("__row_key")), "gone"))
    return rows.join(gone, "__row_key", "left_anti").drop("__row_key")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = written(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return simhash_components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

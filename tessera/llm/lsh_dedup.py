"""Operator 1: embedding near-dedup by Euclidean p-stable hashing.

A vector is normalised (double precision) and hashed in L tables; a table's bucket is the tuple of K random Gaussian
projections, shifted and cut into steps of WIDTH. Between normalised vectors cosine >= t means distance <= sqrt(2 - 2 t), from which
the chance p to agree in one projection follows; K grows with the logarithm of the number of vectors, so that a bucket holds about BUCKET
unrelated ones at any size, and L is what RECALL needs.

Vectors are written once; what is dealt to buckets in each of the L tables is a number and a sketch of 128 signs. Vectors of a bucket whose
sketches differ in far more bits than vectors at that cosine can (SPREAD standard deviations above the mean: one in 10^14 such pairs) are no
pair, so the vectors themselves go only to buckets where they have a likely neighbour, and are compared there exactly.

Exact copies are one vector with a weight. A pair counts in the first table that buckets it together, so links are
counted once without pairs ever being emitted: each comparison returns, for each vector, its number of links and the smallest
vector that the block's links connect it to. Large buckets are cut into blocks that are compared pairwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, shuffle_partitions, small_batches, table, written

COSINE, WIDTH, RECALL, BUCKET, SEED = 0.95, 2.0, 0.99, 8, 7
BLOCK, SIGNS, SPREAD = 512, 128, 8
KEYS = ("t", "dim", "bucket", "i", "j")


def sketch_bits(cosine: float) -> int:
    """Differing signs of two vectors at this cosine at most."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SIGNS * p + SPREAD * math.sqrt(SIGNS * p * (1 - p)))


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection puts two vectors at this distance into the same step (2-stable, Gaussian)."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(K, L) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / BUCKET) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


class Hasher:
    def __init__(self, k: int, n_tables: int, seed: int = SEED):
        self.k, self.n, self.seed, self.made = k, n_tables, seed, {}

    def _for(self, dim: int):
        if dim not in self.made:
            rng = np.random.default_rng((self.seed, dim))
            planes = np.random.default_rng((self.seed, dim, 1)).standard_normal((dim, SIGNS))
            self.made[dim] = rng.standard_normal((dim, self.k * self.n)), rng.uniform(0, WIDTH, self.k * self.n), rng.integers(1, 2**63, (self.k, 1), dtype=np.uint64) | np.uint64(1), planes
        return self.made[dim]

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """(rows, SIGNS / 8) bytes: on which side of random planes each vector lies."""
        return np.packbits(unit @ self._for(unit.shape[1])[3] > 0, axis=1)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(rows, L) int32 bucket numbers: a hash of each table's K steps. That two buckets may share a number costs a comparison, no link."""
        a, b, odd, _ = self._for(unit.shape[1])
        steps = np.floor((unit @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), self.n, self.k)
        h = (steps * odd[:, 0]).sum(axis=2, dtype=np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that very large or small components don't overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash_rows(batches, hasher: Hasher):
    for batch in batches:
        vectors = batch.column("embedding").to_pylist()
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        for dim, at in by_dim.items():
            x = np.array([vectors[i] for i in at], np.float64)
            unit = unit_rows(x)
            h = hasher.buckets(unit)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype="i4") * hasher.n), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(np.full(len(at), dim, "i4")), pa.array([r.tobytes() for r in x], pa.binary()), buckets, pa.array([r.tobytes() for r in hasher.sketches(unit)], pa.binary())],
                names=["rep", "n", "dim", "vector", "buckets", "sketch"],
            )


def _tasks(batches):
    """Rows come sorted by KEYS; the rows of each task, one table after the other."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        change = np.zeros(max(0, len(part) - 1), bool)
        for k in KEYS:
            c = part.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        ends = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a > 1:
                yield part.slice(a, b - a)
        held = part.slice(ends[-1])
    if held is not None and len(held) > 1:
        yield held


def _fixed(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _likely(batches, most: int):
    """The rows whose sketch is close to another one's of their task."""
    for rows in _tasks(batches):
        x, side = _fixed(rows.column("sketch"), np.uint64), rows.column("side").to_numpy()
        near = np.zeros((len(rows), len(rows)), np.uint8)
        for c in range(x.shape[1]):
            near += np.bitwise_count(x[:, c, None] ^ x[None, :, c])
        near = near <= most
        np.fill_diagonal(near, False)
        if rows.column("i")[0] != rows.column("j")[0]:
            near &= side[:, None] != side[None, :]
        if (found := near.any(axis=1)).any():
            (out,) = rows.filter(pa.array(found)).drop_columns(["sketch"]).combine_chunks().to_batches()
            yield out


def local_components(ids: np.ndarray, adjacent: np.ndarray) -> np.ndarray:
    """Smallest id that each row is connected to, by repeated minima over a boolean matrix."""
    labels, top = ids.copy(), np.iinfo(np.int64).max
    while True:
        least = np.minimum(labels, np.where(adjacent, labels, top).min(axis=1, initial=top))
        if (least == labels).all():
            return labels
        labels = least


def _compare(batches, cosine: float):
    """Each vector's links of a task (one block, i = j, or two, told apart by `side`) that no earlier table has, and the least vector they lead to."""
    found: list = []

    def send():
        cols = list(zip(*found, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "root"])

    for rows in _tasks(batches):
        h, side = _fixed(rows.column("buckets"), np.int32), rows.column("side").to_numpy()
        new = ~np.eye(len(rows), dtype=bool)
        if rows.column("i")[0] != rows.column("j")[0]:
            new &= side[:, None] != side[None, :]
        for earlier in range(rows.column("t")[0].as_py()):
            new &= h[:, earlier, None] != h[None, :, earlier]
        some = new.any(axis=1)  # only these are multiplied
        if not some.any():
            continue
        rep, n = rows.column("rep").to_numpy()[some], rows.column("n").to_numpy()[some]
        unit = unit_rows(_fixed(rows.column("vector"), np.float64)[some])
        links = (unit @ unit.T >= cosine) & new[np.ix_(some, some)]
        count = links @ n
        if at := np.flatnonzero(count).tolist():
            roots = local_components(rep, links)
            found += [(int(rep[x]), int(count[x]), int(roots[x])) for x in at]
        if len(found) >= 5000:
            yield send()
            found = []
    yield send()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (rows of other vectors linked directly), component_id, kept: one row for each row of vectors.

    Null, empty and zero vectors, and ones with null or non-finite components, link with nothing, nor do vectors of different lengths.
    Repeated rows are copies and link. A row whose id is null is a component of its own without a number (component_id null, kept true).
    """
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    n = shuffle_partitions(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("embedding").isNotNull() & (F.col("vec_id").isNotNull()) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(usable, F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    good = rows.filter("embedding is not null")
    reps = written(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    hasher = Hasher(*tables_for(reps.count(), cosine, recall))
    hashed = written(reps.repartition(n).mapInArrow(lambda it: _hash_rows(it, hasher), "rep long, n long, dim int, vector binary, buckets array<int>, sketch binary"), "hashed")
    dealt = hashed.select("rep", "dim", "sketch", F.posexplode("buckets").alias("t", "bucket"))
    large = dealt.groupBy("t", "dim", "bucket").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("t", "dim", "bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    placed = dealt.join(large, ["t", "dim", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    tasks = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("t", "dim", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "sketch", (F.col("own") <= F.col("other")).cast("int").alias("side"))
    types = "t int, dim int, bucket int, i int, j int, rep long, side int"
    likely = tasks.repartition(n, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(lambda it: _likely(it, sketch_bits(cosine)), types)
    likely = written(likely, "likely")
    buckets = F.unhex(F.array_join(F.transform("buckets", lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""))
    close = likely.join(hashed.select("rep", "n", "vector", buckets.alias("buckets")), "rep")
    found = written(close.repartition(n, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(lambda it: _compare(it, cosine), "rep long, links long, root long"), "links")
    components = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    named = named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_lsh_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_count(e) = len(e)
    AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), unit AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM ok
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), comp AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(comp.c, v.vec_id) AS component_id, v.vec_id = coalesce(comp.c, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id LEFT JOIN comp ON comp.u = v.vec_id
"""

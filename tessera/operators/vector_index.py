"""An inverted-file index over vectors: cells by k-means, Parquet partitions by cell, compact codes with error bounds, exact re-rank.

A folder holds `centers` (one row a cell), `blocks` (partitions by cell; a row is up to BLOCK vectors as one matrix of bytes: each vector
is the cell's centre plus a scaled byte code, with the length of what the code misses) and `vectors` (partitions by cell, for the
exact cosine). A search probes the cells nearest to each query, so the scan prunes partitions. In a block the codes give bounds on all
cosines; what cannot be among the k best by them is dropped there, and the rest is compared exactly. The nearest cells come first (the square
root of the probed ones): the k-th lower bound there is the floor that rows of all other cells have to reach. The codes lose nothing: a
search that probes all cells gives the rows of a scan. How many cells to probe is measured when the index is built.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.shared import few, small_batches, stored

#: Cells at most; the centres are what a task and the driver hold. By default an index has the square root of its rows.
MAX_CELLS = 4096
#: Vectors that cells are fitted on, about, and queries that the number of probes is fitted on: chosen by hashes of their ids.
SAMPLE, TRIALS, TARGET, TRIAL_K = 50_000, 100, 0.97, 60
BLOCK, GROUPS = 4096, 16
#: Scores are rounded to six places, so bounds leave room for ties.
SLACK = 3e-6
#: Tables of an index with a folder for each cell.
TABLES = {"blocks": "ids array<long>, codes binary, scales binary, missed binary, cell int", "vectors": "vec_id long, embedding array<double>, cell int"}


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: Column) -> Column:
    """Not null, with a length, and without components that are null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first."""
    far = (centers**2).sum(1) - 2 * x @ centers.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _dealt(batches, centers):
    for batch in batches:
        x = _units(_matrix(batch.column("embedding")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(x, centers.value, 1)[:, 0], pa.int32())], names=[*batch.schema.names, "cell"])


def _blocks(batches, centers, size: int):
    """Rows sorted by cell as blocks."""
    held: dict[str, list] = {"cell": [], "vec_id": [], "x": []}

    def out(n):
        cells, ids, x = (np.concatenate(held[c]) for c in ("cell", "vec_id", "x"))
        rows = []
        for cell in np.unique(cells[:n]).tolist():
            here = np.flatnonzero(cells[:n] == cell)
            for i in range(0, len(here), size):
                part = here[i : i + size]
                left = _units(x[part]) - centers.value[cell]
                scale = np.maximum(np.abs(left).max(1), 1e-30) / 127
                code = np.rint(left / scale[:, None]).astype("i1")
                missed = np.linalg.norm(left - code * scale[:, None], axis=1)
                rows.append((cell, ids[part], code.tobytes(), scale.astype("<f8").tobytes(), missed.astype("<f8").tobytes()))
        for c, v in (("cell", cells), ("vec_id", ids), ("x", x)):
            held[c] = [v[n:]]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cell", "ids", "codes", "scales", "missed"])

    n = 0
    for batch in batches:
        if batch.num_rows:
            held["cell"].append(batch.column("cell").to_numpy())
            held["vec_id"].append(batch.column("vec_id").to_numpy())
            held["x"].append(_matrix(batch.column("embedding")))
            n += batch.num_rows
        if n >= size:  # cells are in order, so what is held is one cell's rows or ends of several
            yield out(n)
            n = 0
    if n:
        yield out(n)


def _probed(batches, centers, probes: int):
    """(cell, query_id, vector) of each query's nearest cells."""
    for batch in batches:
        x = _units(_matrix(batch.column("vector")))
        cells = _nearest(x, centers.value, probes) if len(x) else np.zeros((0, probes), int)
        row = np.repeat(np.arange(len(x)), cells.shape[1])
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())).take(pa.array(row)) if len(x) else pa.array([], pa.list_(pa.float64()))
        order = np.tile(np.arange(cells.shape[1]), len(x))
        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), pa.array(order, pa.int32()), batch.column("query_id").take(pa.array(row)), vectors], names=["cell", "probe", "query_id", "vector"])


def _grouped(batches, centers, start: int, stop: int):
    """(cell, query_ids, vectors, floors): a batch's queries by cell, for the cells from the start-th to the stop-th nearest of each; GROUPS cells a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _units(_matrix(batch.column("vector")))
        cells = _nearest(x, centers.value, stop)[:, start:]
        ids, floors = batch.column("query_id").to_numpy(), batch.column("floor").to_numpy()
        cell, row = cells.ravel(), np.repeat(np.arange(len(x)), cells.shape[1])
        order = np.lexsort((row, cell))
        cell, row = cell[order], row[order]
        cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        for i in range(0, len(cuts) - 1, GROUPS):
            here = cuts[i : i + GROUPS + 1]
            rows, at = row[here[0] : here[-1]], here - here[0]
            lists = lambda values, size=1, at=at: pa.ListArray.from_arrays(pa.array(at * size, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(cell[here[:-1]], pa.int32()), lists(ids[rows]), lists(x[rows].ravel(), x.shape[1]), lists(floors[rows])], names=["cell", "query_ids", "vectors", "floors"])


def _bounds(batches, centers, k: int):
    """(query_id, vec_id, cell, low, high) of the rows of a block that can be among the k best of a query (k 0: any) and reach its floor."""
    for batch in batches:
        for cell, ids, codes, scales, missed, queries, vectors, floors in zip(*(batch.column(c) for c in ("cell", "ids", "codes", "scales", "missed", "query_ids", "vectors", "floors")), strict=True):
            cell, ids, center = cell.as_py(), ids.values.to_numpy(), centers.value[cell.as_py()]
            q = vectors.values.to_numpy().reshape(-1, len(center))
            code = np.frombuffer(codes.as_buffer(), "i1").reshape(len(ids), -1).astype(np.float64)
            about = (q @ center)[:, None] + (q @ code.T) * np.frombuffer(scales.as_buffer(), "<f8")
            room = np.frombuffer(missed.as_buffer(), "<f8") + SLACK
            keep = about + room >= floors.values.to_numpy()[:, None]
            if k and len(ids) > k:
                keep &= about + room >= np.partition(about - room, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
            row, at = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [queries.values.take(pa.array(row)), pa.array(ids[at]), pa.array(np.full(len(row), cell, np.int32)), pa.array((about - room)[row, at]), pa.array((about + room)[row, at])], names=["query_id", "vec_id", "cell", "low", "high"]
            )


class VectorIndex:
    """An index that was built under path. centers are read from there unless they are given."""

    def __init__(self, spark: SparkSession, path: str, centers: np.ndarray | None = None):
        self.spark, self.path, self.tables = spark, path, {}
        if centers is None:
            rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()  # MAX_CELLS at most
            centers = np.array([r.center for r in rows])
            self.probes = rows[0].probes if rows else 0
        else:
            self.probes = len(centers)
        self.cells, self.centers = len(centers), spark.sparkContext.broadcast(centers)

    def table(self, name: str) -> DataFrame:
        """One of TABLES; its folders are listed once, not for each search: a listing is a job with a task for each cell, and the driver holds its files."""
        if name not in self.tables:
            self.tables[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        return self.tables[name]

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(cell, probe, query_id, vector): queries (query_id long, vector) with their nearest cells, probe 0 being the nearest."""
        n, centers = min(probes or self.probes, self.cells), self.centers
        rows = queries.filter(usable(F.col("vector"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        return rows.mapInArrow(lambda it: _probed(it, centers, n), "cell int, probe int, query_id long, vector array<double>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, place, vec_id, score): the k vectors that are closest by cosine in the probed cells; score is rounded to six places, ties by
        vec_id. allowed (vec_id): only these are found. Queries without a direction find nothing; probes=cells is an exact search.
        """
        if not self.cells:
            return self.spark.createDataFrame([], "query_id long, place int, vec_id long, score double")
        small_batches(self.spark)
        n, keep = min(probes or self.probes, self.cells), 0 if allowed is not None else k
        asked = queries.filter(usable(F.col("vector"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        asked = stored(asked, "asked")
        here = F.lit(True)  # prunes both scans
        if n < self.cells:
            cells = [r.cell for r in self.probed(asked, n).select("cell").distinct().collect()]  # MAX_CELLS at most
            here = F.col("cell").isin(cells) if len(cells) < self.cells else here
        first = math.ceil(math.sqrt(n))
        found = stored(self._met(asked.withColumn("floor", F.lit(-2.0)), here, 0, first, keep, allowed), "bounds")
        if first < n:
            floors = asked.join(_least(found, k).withColumnRenamed("least", "floor"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
            found = found.unionByName(stored(self._met(floors, here, first, n, keep, allowed), "bounds"))
        close = found.join(_least(found, k), "query_id").filter("high >= least").select("query_id", "vec_id", "cell")
        compared = close.join(self.table("vectors").filter(here), ["cell", "vec_id"]).join(asked, "query_id")
        scored = compared.select("query_id", "vec_id", F.round(scores.cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k).select("query_id", "place", "vec_id", "score")

    def _met(self, asked: DataFrame, here: Column, start: int, stop: int, keep: int, allowed: DataFrame | None) -> DataFrame:
        """Bounds of queries (query_id, vector, floor) in their cells from the start-th to the stop-th nearest."""
        centers = self.centers
        grouped = asked.select("query_id", "vector", "floor").mapInArrow(lambda it: _grouped(it, centers, start, stop), "cell int, query_ids array<long>, vectors array<double>, floors array<double>")
        found = self.table("blocks").filter(here).join(grouped, "cell").mapInArrow(lambda it: _bounds(it, centers, keep), "query_id long, vec_id long, cell int, low double, high double")
        return found if allowed is None else found.join(allowed.select("vec_id"), "vec_id", "left_semi")


def _least(found: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th of each query's lower bounds; -2 where there are fewer."""
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    return found.withColumn("n", F.row_number().over(by_low)).filter(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).otherwise(-2.0).alias("least"))


def _sampled(rows: DataFrame, n: int, of: int) -> DataFrame:
    """About n of so many rows, all if there are no more; the same at any time, and no task meets all of them."""
    return rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(of)) < n) if of > n else rows


def _normed(batches):
    for batch in batches:
        x = _units(_matrix(batch.column("embedding")))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["unit"])


def _fitted(units: DataFrame, cells: int) -> list[list[float]]:
    """Centres by k-means. Blocks of rows meet all centres at once: the solver by rows runs a job with a task for each centre in every round
    and keeps distances of all pairs of centres, all through the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=cells, seed=7, maxIter=10, solver="block").fit(units.select(array_to_vector("unit").alias("features")))
    return [c.tolist() for c in model.clusterCenters()]


def build(vectors: DataFrame, path: str, cells: int | None = None, target: float | None = TARGET, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> VectorIndex:
    """Index every vector that has a direction (not null or zero, all components finite) under path.

    Cells are fitted on about SAMPLE vectors. The number of probes is the least that gives the share `target` of the TRIAL_K nearest of TRIALS sampled
    vectors; without a target all cells are probed. Cells of any size are written as several files. An empty table gives an index that finds nothing. Ids are unique;
    all vectors have one length.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")))
    n = rows.count()
    if not n:
        spark.createDataFrame([], "cell int, center array<double>, probes int").write.parquet(f"{path}/centers")
        return VectorIndex(spark, path)
    cells = max(1, min(cells or math.ceil(math.sqrt(n)), MAX_CELLS, n))
    sample = stored(_sampled(rows, SAMPLE, n).select("embedding").mapInArrow(_normed, "unit array<double>"), "sample")
    centers = _fitted(sample, cells)
    held = spark.sparkContext.broadcast(np.array(centers))
    dealt = rows.mapInArrow(lambda it: _dealt(it, held), "vec_id long, embedding array<double>, cell int").hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id")
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    dealt = spark.read.parquet(f"{path}/vectors").select("cell", "vec_id", "embedding").hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id")
    dealt.mapInArrow(lambda it: _blocks(it, held, block), "cell int, ids array<long>, codes binary, scales binary, missed binary").write.partitionBy("cell").parquet(f"{path}/blocks")
    index = VectorIndex(spark, path, held.value)
    if target:
        trials = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        index.probes = _calibrated(index, stored(trials, "trials"), target)
    spark.createDataFrame([(i, c, index.probes) for i, c in enumerate(centers)], "cell int, center array<double>, probes int").write.parquet(f"{path}/centers")
    return index


def _calibrated(index: VectorIndex, queries: DataFrame, target: float) -> int:
    """The least number of probes that finds that share of the queries' neighbours."""
    true = stored(index.search(queries, TRIAL_K), "true")
    where = true.join(index.table("vectors").select("vec_id", "cell"), "vec_id")
    by_probe = where.join(index.probed(queries).select("query_id", "cell", "probe"), ["query_id", "cell"]).groupBy("probe").agg(F.count("*").alias("n"))
    counts = {r.probe: r.n for r in few(by_probe, MAX_CELLS)}
    total, so_far = sum(counts.values()), 0
    for probe in sorted(counts):
        so_far += counts[probe]
        if so_far >= target * total:
            return probe + 1
    return 1


def recall(true: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's true rows that were found. Both are written first, so no plan holds two searches, and
    rows meet in a group instead of a join, so neither side is ever taken to the driver."""
    true, found = (stored(df.select("query_id", "vec_id"), label) for df, label in ((true, "true"), (found, "found")))
    both = true.withColumns({"wanted": F.lit(1), "hit": F.lit(0)}).unionByName(found.withColumns({"wanted": F.lit(0), "hit": F.lit(1)}))
    rows = both.groupBy("query_id", "vec_id").agg(F.max("wanted").alias("wanted"), F.max("hit").alias("hit")).filter("wanted = 1")
    return rows.groupBy("query_id").agg(F.avg("hit").alias("recall"))

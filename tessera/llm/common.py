"""Helpers that the training-data operators share: table access, intermediate tables, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Rows in one Arrow batch. Texts can be very long, so batches hold few rows and a worker's memory stays bounded.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the memory of Arrow batches by rows; wide rows (whole documents) make the default of 10,000 too large. Every operator that uses Python
    workers sets this for itself, so none depends on what ran before it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it back. Lost executors cost nothing that was written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append((path, made))
    return made


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def remove(df: DataFrame) -> None:
    """Delete the files behind a table made by written() that no later plan reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


#: Tables written within each temporary() that is open.
_open: list[list[tuple[str, DataFrame]]] = []


@contextmanager
def temporary():
    """Tables written inside are deleted at the end, but for those given to keep()."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append([])
    try:
        yield keep
    finally:
        for path, made in _open.pop():
            if not any(made is k for k in kept):
                _delete(made.sparkSession, path)
            elif _open:
                _open[-1].append((path, made))


def _is_forest(edges: DataFrame) -> bool:
    """Every edge (u, v) leads from a node with no other edge to a node that is no u: the links are stars around their smallest nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count_if(F.col("out") == 0).alias("inner"))
    return roles.filter("out > 1 or (out > 0 and inner > 0)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node joins the smallest node of its neighbourhood.

    The minimum is an aggregate with map-side combine and the way back a plain equi-join (which adaptive execution
    splits when skewed), so a hub with very many neighbours never has to fit one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint links -> (node, component), component being the smallest node reachable; linked nodes only.

    Alternating large-star and small-star steps until the edges are a forest of stars. Each round is written to the
    shared folder; the driver sees only whether it is the last. Null ends are ignored.
    """
    edges = written(edges.select(F.greatest(F.col("u").cast("long"), F.col("v").cast("long")).alias("u"), F.least(F.col("u").cast("long"), F.col("v").cast("long")).alias("v")).filter("u <> v").distinct(), "edges")
    while not _is_forest(edges):
        after = written(_star(_star(edges, True), False), "edges")
        remove(edges)
        edges = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""What changed between two snapshots of a table, found by a tree of hashes over partitions.

A snapshot's rows are dealt into partitions by the hash of their key. A partition's digest is made of sums over row hashes, so rows need no
order; FANOUT partitions make a node, and so on up to a root. A comparison goes down from the roots through nodes that differ, and reads the
rows of partitions that differ, of both snapshots; partitions that are the same are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 16
_NODE = "level int, idx int, digest string"


def write(rows: DataFrame, key: str, path: str, levels: int = 2) -> None:
    """A snapshot of rows under path: `rows` (FANOUT ** levels partitions) and `tree`. Keys are unique."""
    parts, columns = FANOUT**levels, sorted(rows.columns)
    rows.limit(0).write.parquet(f"{path}/schema")
    rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/rows")
    held = _rows(rows.sparkSession, path)
    sums = [F.sum(F.xxhash64(F.lit(salt), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")) for salt in (1, 2)]
    level = held.groupBy(F.col("part").alias("idx")).agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), *[s.cast("string") for s in sums]), 256).alias("digest"))
    for n in range(levels, -1, -1):
        level.select(F.lit(n).alias("level"), "idx", "digest").write.mode("append").parquet(f"{path}/tree")
        below = rows.sparkSession.read.schema(_NODE).parquet(f"{path}/tree").filter(F.col("level") == n)
        children = F.array_sort(F.collect_list(F.struct("idx", "digest")))  # FANOUT at most
        level = below.groupBy(F.expr(f"idx div {FANOUT}").cast("int").alias("idx")).agg(F.sha2(F.to_json(children), 256).alias("digest"))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema.add("part", T.IntegerType())).parquet(f"{path}/rows")


def differing(spark: SparkSession, old: str, new: str) -> list[int]:
    """Partitions whose rows are not the same, found level by level below nodes that differ."""
    trees = [spark.read.schema(_NODE).parquet(f"{p}/tree") for p in (old, new)]
    depths = {d for t in trees if (d := t.agg(F.max("level")).first()[0]) is not None}  # a snapshot without rows has no tree
    if len(depths) > 1:
        raise ValueError("snapshots have different numbers of partitions")
    levels = max(depths, default=0)
    below = [0]
    for n in range(levels + 1):
        sides = [t.filter((F.col("level") == n) & F.col("idx").isin(below)).select("idx", F.col("digest").alias(f"d{i}")) for i, t in enumerate(trees)]
        found = sides[0].join(sides[1], "idx", "full").filter(~F.col("d0").eqNullSafe(F.col("d1"))).select("idx").collect()  # the partitions at most
        if n == levels or not found:
            return sorted(r.idx for r in found)
        below = [r.idx * FANOUT + k for r in found for k in range(FANOUT)]
    return []


def changes(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """(key, change) of rows that were created, changed or deleted between two snapshots."""
    parts = differing(spark, old, new)
    sides = []
    for i, path in enumerate((old, new)):
        rows = _rows(spark, path)
        columns = sorted(c for c in rows.columns if c != "part")
        here = rows.filter(F.col("part").isin(parts))
        sides.append(here.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(f"r{i}")))
    both = sides[0].join(sides[1], key, "full")
    change = F.when(F.col("r0").isNull(), "created").when(F.col("r1").isNull(), "deleted").when(F.col("r0") != F.col("r1"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")

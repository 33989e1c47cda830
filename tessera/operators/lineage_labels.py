"""Lineage of all nodes at once: distance labels, so that a read is one join and no walk.

Nodes leave the graph in rounds. In a round those leave that come before all their neighbours, by the number of paths that run through
them (its power of two), then by hash; each path of two edges through one that leaves becomes an edge of the length of both. Chains,
trees and stars are gone after rounds in the logarithm of their size, and a node with very many neighbours waits until most have
left. Then, from the last round to the first, a node's labels are itself and the labels of the neighbours it left behind. On a
shortest path some node left last; both ends have it among their labels, so the distance is the least sum over common labels. Cycles
need no care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder, stored

_LEFT = "round int, forth boolean, node string, other string, w long"
_LABEL = "forth boolean, node string, hub string, d long"


def _key(node: str):
    paths = F.col("n_in") * F.col("n_out") + 1
    return F.struct(F.floor(F.log2(paths)).alias("paths"), F.xxhash64(node).alias("hash"), F.col(node).alias("node"))


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of the nodes that leave: forth, node, other, w; edges (u, v, w) that stay and the new ones)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    keys = stored(ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).select("node", _key("node").alias("key")), "keys")
    both = edges.join(keys.toDF("u", "ku"), "u").join(keys.toDF("v", "kv"), "v")
    later = both.select(F.when(F.col("ku") < F.col("kv"), F.col("v")).otherwise(F.col("u")).alias("node")).distinct()
    leave = keys.join(later, "node", "left_anti").select("node", F.lit(True).alias("gone"))
    marked = stored(edges.join(leave.toDF("u", "u_gone"), "u", "left").join(leave.toDF("v", "v_gone"), "v", "left"), "marked")
    out = marked.filter("u_gone").select(F.lit(True).alias("forth"), F.col("u").alias("node"), F.col("v").alias("other"), "w")
    back = marked.filter("v_gone").select(F.lit(False).alias("forth"), F.col("v").alias("node"), F.col("u").alias("other"), "w")
    through = back.select("node", F.col("other").alias("u"), F.col("w").alias("w1")).join(out.select("node", F.col("other").alias("v"), "w"), "node").filter("u <> v").select("u", "v", F.expr("w1 + w").alias("w"))
    stay = marked.filter("u_gone is null and v_gone is null").select("u", "v", "w").unionByName(through)
    return out.unionByName(back), stay.groupBy("u", "v").agg(F.min("w").alias("w"))


class LineageLabels:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.labels = spark, spark.read.schema(_LABEL).parquet(path)

    def _met(self, starts: DataFrame, downstream: bool = True) -> DataFrame:
        """starts: labels of the nodes that are asked for. (start, node, depth)."""
        ends = self.labels.filter(F.col("forth") != downstream).select("hub", "node", F.col("d").alias("d2"))
        met = starts.select(F.col("node").alias("start"), "hub", "d").join(ends, "hub").groupBy("start", "node").agg(F.min(F.col("d") + F.col("d2")).cast("int").alias("depth"))
        return met.filter("start <> node")

    def pairs(self, downstream: bool = True) -> DataFrame:
        """C03 for all starts: start, node, depth."""
        return self._met(self.labels.filter(F.col("forth") == downstream), downstream)

    def reachable(self, start: str, downstream: bool = True) -> DataFrame:
        """Node, depth of all nodes that can be reached from one, each with its least depth; the start is left out."""
        return self._met(self.labels.filter((F.col("node") == start) & (F.col("forth") == downstream)), downstream).select("node", "depth")


def build(edges: DataFrame, path: str | None = None) -> LineageLabels:
    """Labels of (upstream, downstream) edges, in a folder. Null ends, repeated edges and edges from a node to itself change nothing."""
    spark, path, left = edges.sparkSession, path or new_folder(edges.sparkSession, "labels"), new_folder(edges.sparkSession, "left")
    now = edges.select(F.col("upstream").cast("string").alias("u"), F.col("downstream").cast("string").alias("v"), F.lit(1).cast("long").alias("w")).filter("u <> v").distinct()
    now = stored(now, "edges")
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("forth"), "node", F.col("node").alias("hub"), F.lit(0).cast("long").alias("d")).write.parquet(path)
    rounds = 0
    while not now.isEmpty():
        gone, after = _round(now)
        gone.select(F.lit(rounds).alias("round"), "*").write.mode("append").parquet(left)
        now, rounds = stored(after, "edges"), rounds + 1
    for r in reversed(range(rounds)):
        mine = spark.read.schema(_LEFT).parquet(left).filter(F.col("round") == r).select("forth", "node", F.col("other").alias("at"), "w")
        above = spark.read.schema(_LABEL).parquet(path).withColumnRenamed("node", "at")
        mine.join(above, ["forth", "at"]).groupBy("forth", "node", "hub").agg(F.min(F.col("w") + F.col("d")).alias("d")).write.mode("append").parquet(path)
    return LineageLabels(spark, path)

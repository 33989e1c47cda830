"""Closures over team trees and lineage graphs, and reads of dependency edges.

Closures over teams are recursive common table expressions; Spark runs a level at a time and fails beyond 100 levels or a million rows.
Team trees stay far below both. Lineage is followed to its end, however deep it is.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .lineage_labels import LineageLabels

#: Levels after which what was seen becomes one table again, so that a deep walk does not join ever more pieces.
MERGE_LEVELS = 16


def visible_teams(memberships: DataFrame, teams: DataFrame) -> DataFrame:
    """agent_id, path, direct: teams of each agent and all teams above them. A team may be both direct and above another."""
    spark = memberships.sparkSession
    # agents share teams, so each team's chain upwards is followed once, not once for each agent
    chains = spark.sql(
        """WITH RECURSIVE up(team_id, id, path, parent_id) AS (
             SELECT id, id, path, parent_id FROM {teams}
             UNION ALL SELECT up.team_id, t.id, t.path, t.parent_id FROM up JOIN {teams} t ON t.id = up.parent_id)
           SELECT team_id, path, team_id = id AS direct FROM up""",
        teams=teams,
    )
    return memberships.join(chains, "team_id").groupBy("agent_id", "path").agg(F.bool_or("direct").alias("direct"))


def reachable(edges: DataFrame, start: str, downstream: bool = True) -> DataFrame:
    """Node, depth of all nodes that can be reached from one, each with its least depth; the start is left out.

    A path never visits a node twice, so cycles end; depth has no bound. The frontier of each level is deduplicated
    before it is followed: work is bounded by the edges, not by the number of paths.
    """
    spark = edges.sparkSession
    a, b = ("upstream", "downstream") if downstream else ("downstream", "upstream")
    seen = frontier = spark.createDataFrame([(start, 0)], "node string, depth int")
    for depth in count(1):
        step = edges.select(F.col(a).alias("from"), F.col(b).alias("node")).join(frontier.select(F.col("node").alias("from")), "from", "left_semi").select("node").distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = settled(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % MERGE_LEVELS == 0:
            seen = settled(seen.repartition("node"))
    return seen.filter("depth > 0")


def lineage_of(labels: LineageLabels, nodes: DataFrame, start: str, downstream: bool = True) -> DataFrame:
    """Reachable nodes that are not archived or deleted; hidden nodes are still walked through. nodes: node, status."""
    found = labels.reachable(start, downstream)
    return found.join(nodes, "node", "left").filter(~F.coalesce(F.col("status"), F.lit("active")).isin("archived", "deleted")).select("node", "depth")


def dependencies_of(edges: DataFrame, contexts: DataFrame, context_id: int) -> DataFrame:
    """Edges with this context at either end, with both uris."""
    names = contexts.select("id", "uri")
    near = edges.filter((F.col("dependent_id") == context_id) | (F.col("dependency_id") == context_id))
    near = near.join(names.toDF("dependent_id", "dependent_uri"), "dependent_id").join(names.toDF("dependency_id", "dependency_uri"), "dependency_id")
    return near.select("dependent_uri", "dependency_uri", "dep_type", "pinned_version")


def dependents_as_of(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each change with all edges to its context that existed when it happened."""
    e = edges.withColumnRenamed("dependency_id", "context_id")
    return changes.join(e, "context_id").filter(F.col("created_at") <= F.col("ts"))

"""What a change of a context means for its dependents and subscribers: rules, actions, delivery state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from . import graph

SILENT = ("marked_stale", "deleted")
LEASE_SECONDS, BATCH = 300, 100


def propagating(changes: DataFrame) -> DataFrame:
    """These kinds are not passed on; so cycles end."""
    return changes.filter(~F.col("change_type").isin(*SILENT))


def edge_action(dep_type: Column, change_type: Column, pinned: Column, new_version: Column, breaking: Column) -> Column:
    """N05 for dependency edges."""
    skill = F.when((change_type != "version_published") | pinned.isNull() | (pinned >= new_version), "no_action").when(F.coalesce(breaking, F.lit(False)), "mark_stale").otherwise("notify")
    return F.when(dep_type == "skill_version", skill).when(dep_type == "table_schema", "auto_update").when((dep_type == "derived_from") & (change_type == "modified"), "notify").otherwise("no_action")


def actions(changes: DataFrame, edges: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """event_id, target_kind (context or agent), target, action for each dependent as of the event's time and, of published
    versions, each subscriber: notify where floating, advisory where pinned."""
    live = propagating(changes)
    of_edges = graph.dependents_as_of(live, edges).select("event_id", F.lit("context").alias("target_kind"), F.col("dependent_id").cast("string").alias("target"), edge_action(F.col("dep_type"), F.col("change_type"), F.col("pinned_version"), F.col("new_version"), F.col("is_breaking")).alias("action"))
    published = live.filter("change_type = 'version_published'").select("event_id", F.col("context_id").alias("skill_id"))
    of_agents = published.join(subscriptions, "skill_id").select("event_id", F.lit("agent").alias("target_kind"), F.col("agent_id").alias("target"), F.when(F.col("pinned_version").isNull(), "notify").otherwise("advisory").alias("action"))
    return of_edges.unionByName(of_agents)


def effects(taken: DataFrame) -> DataFrame:
    """Contexts that actions change: id, stale, update. notify, advisory and no_action change nothing."""
    on = taken.filter("target_kind = 'context' and action in ('mark_stale', 'auto_update')").groupBy(F.col("target").cast("long").alias("id"))
    return on.agg(F.bool_or(F.col("action") == "mark_stale").alias("stale"), F.bool_or(F.col("action") == "auto_update").alias("update"))


def regenerated(contexts: DataFrame, sources: DataFrame) -> DataFrame:
    """Dependents (id, dependency_id) with new l0 and l1 from their own l2 and the source's content (l2, or l1, or l0); `outcome` is
    stale where either is missing."""
    own = contexts.select("id", F.col("l2_content").alias("own"), "context_type")
    source = contexts.select(F.col("id").alias("dependency_id"), F.coalesce("l2_content", "l1_content", "l0_content").alias("source"))
    both = sources.select("id", "dependency_id").join(own, "id").join(source, "dependency_id", "left")
    body = F.concat("own", F.lit("\n\n[auto-update]\n"), "source")
    return both.select("id", "dependency_id", F.when(F.col("own").isNull() | F.col("source").isNull(), "stale").otherwise("updated").alias("outcome"), text.level0(body, F.col("context_type")).alias("l0_content"), text.level1(body).alias("l1_content"))


def claimable(deliveries: DataFrame, now: Column, most: int = BATCH) -> DataFrame:
    """Deliveries that a worker takes next: pending or retry and due, or processing with an expired lease; oldest first."""
    due = F.col("delivery_status").isin("pending", "retry") & (F.coalesce("next_retry_at", now) <= now)
    expired = (F.col("delivery_status") == "processing") & (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(LEASE_SECONDS)))
    return deliveries.filter(due | expired).orderBy("ts", "event_id").limit(most)


def finished(deliveries: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Claimed deliveries after their results (event_id, ok): processed, or retry after 5 seconds for each attempt, 300 at most."""
    joined = deliveries.withColumn("attempt_count", F.col("attempt_count") + 1).join(results.select("event_id", "ok"), "event_id", "left")
    wait = F.make_dt_interval(secs=scores.backoff_seconds(F.col("attempt_count")))
    done = F.coalesce("ok", F.lit(False))
    return joined.withColumns({"delivery_status": F.when(done, "processed").otherwise("retry"), "next_retry_at": F.when(~done, now + wait), "processed_at": F.when(done, now)}).drop("ok")

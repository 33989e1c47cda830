"""Skills: numbering of published versions, heads, subscriptions, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(commands: DataFrame) -> DataFrame:
    """Publish commands with their version: 1, 2, ... of each skill by (ts, event_id)."""
    return commands.withColumn("version", F.row_number().over(Window.partitionBy("skill_id").orderBy("ts", "event_id")).cast("int"))


def heads(versions: DataFrame) -> DataFrame:
    """The newest version of each skill, and the newest published one (null if there is none)."""
    return versions.groupBy("skill_id").agg(F.max("version").alias("head"), F.max(F.when(F.col("status") == "published", F.col("version"))).alias("published"))


def listed(versions: DataFrame, skill_id: int) -> DataFrame:
    """Published and deprecated versions, newest first."""
    return versions.filter((F.col("skill_id") == skill_id) & F.col("status").isin("published", "deprecated")).select("version", "status", "is_breaking", "content").orderBy(F.desc("version"))


def subscribed(commands: DataFrame, versions: DataFrame) -> DataFrame:
    """The latest subscription of each (agent, skill); a pin must be a published version, else the command is refused (`error` 404)."""
    pins = versions.filter("status = 'published'").select("skill_id", F.col("version").alias("pinned_version"), F.lit(True).alias("__ok"))
    checked = commands.join(pins, ["skill_id", "pinned_version"], "left")
    return checked.withColumn("error", F.when(F.col("pinned_version").isNotNull() & F.col("__ok").isNull(), 404)).drop("__ok")


def resolved(requests: DataFrame, versions: DataFrame, subscriptions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(agent_id, skill_id, wanted) -> version, content, advisory, error for all requests at once.

    An explicit version comes first, then the agent's pin; both read a published or deprecated version. Else the skill's own row in contexts is its
    head: its version and L2, whatever the newest published version is. Advisories: a deprecated version; or, of a pin, that a newer version is
    published (which replaces the other). The error is 404 for an unknown version, or a head without any published version.
    """
    pins = subscriptions.groupBy("agent_id", "skill_id").agg(F.max("pinned_version").alias("pin"))
    known = versions.filter(F.col("status").isin("published", "deprecated")).select("skill_id", F.col("version").alias("chosen"), F.col("status").alias("chosen_status"), F.col("content").alias("__content"), F.lit(True).alias("__there"))
    own = contexts.select(F.col("id").alias("skill_id"), F.col("version").alias("__head"), F.col("l2_content").alias("__l2"))
    r = requests.join(pins, ["agent_id", "skill_id"], "left").join(heads(versions), "skill_id", "left").join(own, "skill_id", "left")
    r = r.withColumn("chosen", F.coalesce("wanted", "pin")).join(known, ["skill_id", "chosen"], "left")
    floats = F.col("chosen").isNull()
    error = F.when(floats & (F.col("published").isNull() | F.col("__head").isNull()), 404).when(~floats & F.col("__there").isNull(), 404)
    by_pin = F.col("wanted").isNull() & F.col("pin").isNotNull()
    advice = F.when(by_pin & (F.col("published") > F.col("chosen")), F.format_string("v%d available, currently pinned to v%d", "published", "chosen")).when(F.col("chosen_status") == "deprecated", F.format_string("v%d is deprecated", "chosen"))
    sound = error.isNull()
    return r.select("agent_id", "skill_id", F.when(sound, F.coalesce("chosen", "__head")).alias("version"), F.when(sound, F.when(floats, F.col("__l2")).otherwise(F.col("__content"))).alias("content"), F.when(sound, advice).alias("advisory"), error.alias("error"))

"""Contexts as keyed rows: validation, creation, updates under optimistic versions, reads, memories, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import access

LEVELS = {"L0": "l0_content", "L1": "l1_content", "L2": "l2_content"}


def projected(contexts: DataFrame, level: str) -> DataFrame:
    """One content tier; a missing L2 is empty."""
    return contexts.select("id", "uri", F.coalesce(LEVELS[level], F.lit("")).alias("content"))


def validity(uri: Column, scope: Column, owner: Column) -> Column:
    """Null for a valid row, else what is wrong. The root team's path is empty, not null."""
    where = F.when(scope == "team", F.when(owner == "", "ctx://team/").otherwise(F.concat(F.lit("ctx://team/"), owner, F.lit("/"))))
    where = where.when(scope == "agent", F.concat(F.lit("ctx://agent/"), owner, F.lit("/"))).when(scope == "datalake", "ctx://datalake/")
    return (
        F.when(scope == "user", "scope is not supported")
        .when((scope == "datalake") & owner.isNotNull(), "datalake has no owner")
        .when(scope.isin("team", "agent") & owner.isNull(), "an owner is needed")
        .when(where.isNull() | uri.isNull(), "unknown scope or uri")
        .when(~uri.startswith(where), "uri does not fit the scope")
    )


def created(commands: DataFrame, existing: DataFrame) -> DataFrame:
    """Create commands (seq, account_id, uri, scope, owner_space, ...) with `error`: 400 invalid, 403 where a column `writable` says no (L03), 409 key
    taken by a row or by an earlier command; null: created as version 1."""
    key = ["account_id", "uri"]
    first = commands.groupBy(*key).agg(F.min("seq").alias("__first"))
    taken = existing.select(*key, F.lit(True).alias("__taken")).distinct()
    checked = commands.join(first, key, "left").join(taken, key, "left")
    bad = validity(F.col("uri"), F.col("scope"), F.col("owner_space")).isNotNull()
    denied = ~F.coalesce("writable", F.lit(False)) if "writable" in commands.columns else F.lit(False)
    return checked.withColumn("error", F.when(bad, 400).when(denied, 403).when(F.col("__taken") | (F.col("seq") != F.col("__first")), 409)).drop("__first", "__taken")


def updated(contexts: DataFrame, commands: DataFrame) -> DataFrame:
    """Contexts after update and delete commands (seq, id, op, expected, content), taken in order of seq.

    A command takes effect if `expected` is the version that the ones before it left (428 without one, 409 otherwise, 404 for a
    deleted row). An update adds 1 to the version and revives a stale row. `errors` counts the refused commands.

    Bound: the commands of one id, contents included, become one array in one row, so all of them have to fit a task's memory (and
    2 GB); beyond that the query fails, it loses none.
    """
    per_row = commands.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "expected", "content"))).alias("__c"))
    joined = contexts.join(per_row, "id", "left")
    start = F.struct(F.col("version").alias("version"), F.col("status").alias("status"), F.col("l2_content").alias("content"), F.lit(0).alias("errors"))

    def step(s, c):
        fits = F.coalesce((c["expected"] == s["version"]) & (s["status"] != "deleted"), F.lit(False))
        removes = c["op"] == "delete"
        return F.struct(
            F.when(fits & ~removes, s["version"] + 1).otherwise(s["version"]).cast("int").alias("version"),
            F.when(fits & removes, "deleted").when(fits & (s["status"] == "stale"), "active").otherwise(s["status"]).alias("status"),
            F.when(fits & ~removes, c["content"]).otherwise(s["content"]).alias("content"),
            F.when(fits, s["errors"]).otherwise(s["errors"] + 1).cast("int").alias("errors"),
        )

    end = F.aggregate(F.coalesce("__c", F.array().cast("array<struct<seq:bigint,op:string,expected:int,content:string>>")), start, step)
    out = joined.withColumn("__end", end).withColumns({"version": F.col("__end.version"), "status": F.col("__end.status"), "l2_content": F.col("__end.content"), "errors": F.col("__end.errors")})
    return out.select(*contexts.columns, "errors")


def refusals(contexts: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (seq, id, op, expected, sets_status) against the rows as they are, with `error`.

    428 an update without an expected version, 400 one that sets the status, 404 no such row or a deleted one, 403 where a column `writable` of contexts says
    no (L03), 400 an update of a skill, 409 another version.
    """
    rows = contexts.select("id", F.col("version").alias("__version"), F.col("status").alias("__status"), F.col("context_type").alias("__type"), (F.col("writable") if "writable" in contexts.columns else F.lit(True)).alias("__writes"))
    update = F.col("op") == "update"
    missing = F.col("__status").isNull() | (F.col("__status") == "deleted")
    error = F.when(update & F.col("expected").isNull(), 428).when(update & F.col("sets_status"), 400).when(missing, 404).when(~F.col("__writes"), 403).when(update & (F.col("__type") == "skill"), 400).when(F.col("expected") != F.col("__version"), 409)
    return commands.join(rows, "id", "left").withColumn("error", error).drop("__version", "__status", "__type", "__writes")


def events_of(commands: DataFrame, change_type: str) -> DataFrame:
    """The change events of accepted commands (error is null): seq, uri, change_type."""
    return commands.filter("error is null").select("seq", "uri", F.lit(change_type).alias("change_type"))


def levels_written(contexts: DataFrame, commands: DataFrame) -> DataFrame:
    """Contexts after level writes (seq, id, level, content): the latest of each level counts, each write adds 1 to the version; deleted
    rows stay as they are."""
    n = commands.groupBy("id").agg(F.count("*").cast("int").alias("__n"), *[F.max_by(F.when(F.col("level") == k, F.col("content")), F.when(F.col("level") == k, F.col("seq"))).alias(f"__{k}") for k in LEVELS])
    out = contexts.join(n, "id", "left")
    live = (F.col("status") != "deleted") & F.col("__n").isNotNull()
    changed = {c: F.when(live, F.coalesce(f"__{k}", c)).otherwise(F.col(c)) for k, c in LEVELS.items()}
    return out.withColumns(changed | {"version": F.when(live, F.col("version") + F.col("__n")).otherwise(F.col("version")).cast("int")}).select(*contexts.columns)


def level2(contexts: DataFrame, files: DataFrame) -> DataFrame:
    """Id, content, error: L2 of contexts from their file (file_path; files: path, text) where they have one, else from the row; 404 for a file that is
    missing."""
    joined = contexts.join(files.select(F.col("path").alias("file_path"), F.col("text").alias("__file"), F.lit(True).alias("__there")), "file_path", "left")
    gone = F.col("file_path").isNotNull() & F.col("__there").isNull()
    return joined.select("id", F.when(F.col("file_path").isNotNull(), F.col("__file")).otherwise(F.coalesce("l2_content", F.lit(""))).alias("content"), F.when(gone, 404).alias("error"))


def memories_added(commands: DataFrame) -> DataFrame:
    """Memories (agent_id, name, text) as rows of the agent's own space, version 1, with their uri and levels."""
    uri = F.concat(F.lit("ctx://agent/"), "agent_id", F.lit("/memories/"), "name")
    return commands.select(uri.alias("uri"), F.lit("memory").alias("context_type"), F.lit("agent").alias("scope"), F.col("agent_id").alias("owner_space"), F.lit(1).alias("version"), F.lit("active").alias("status"), text.level0(F.col("text"), F.lit("memory")).alias("l0_content"), text.level1(F.col("text")).alias("l1_content"), F.col("text").alias("l2_content"))


def stat(contexts: DataFrame, uri: str) -> DataFrame:
    """The row of a uri without its contents."""
    return contexts.filter((F.col("uri") == uri) & (F.col("status") != "deleted")).drop(*LEVELS.values())


def children(contexts: DataFrame, prefix: str, policies: DataFrame, teams: DataFrame, agent: str) -> DataFrame:
    """The names below a uri prefix that the agent may read, sorted. `_` and `%` in the prefix are wildcards."""
    prefix = prefix.rstrip("/") + "/"
    below = access.readable(contexts.filter(F.col("uri").like(prefix + "%")), policies, teams, agent)
    return below.select(text.child_segment(F.col("uri"), prefix).alias("name")).filter("name <> ''").distinct().orderBy("name")


def memories(contexts: DataFrame, policies: DataFrame, teams: DataFrame, agent: str) -> DataFrame:
    """Memories the agent may read, last used first."""
    return access.readable(contexts.filter("context_type = 'memory'"), policies, teams, agent).select("id", "uri", "last_accessed_at").orderBy(F.desc("last_accessed_at"), "id")


def promoted(contexts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, edges) of promote commands (id, team): an agent's memory as the team's shared knowledge, and derived_from edges."""
    rows = contexts.filter("context_type = 'memory' and scope = 'agent' and status <> 'deleted'").join(commands.select("id", "team"), "id")
    to = F.concat(F.lit("ctx://team/"), F.when(F.col("team") == "", "memories").otherwise(F.col("team")), F.lit("/shared_knowledge/"), text.last_segment(F.col("uri")))
    copies = rows.select(to.alias("uri"), F.lit("memory").alias("context_type"), F.lit("team").alias("scope"), F.col("team").alias("owner_space"), F.lit(1).alias("version"), "l0_content", "l1_content", "l2_content", F.col("id").alias("derived_from"))
    return copies, copies.select(F.col("uri").alias("dependent_uri"), F.col("derived_from").alias("dependency_id"), F.lit("derived_from").alias("dep_type"))

"""Who may read and write what: team visibility, policies, field masks.

An agent's teams and the policies that concern it are read first. Where they are few (MOST), they are literals and contexts are decided where they
are scanned, without a shuffle. Where there are more, policies meet contexts by equi-joins: exact patterns by uri, prefix patterns by
the prefix of the uri that has the pattern's length.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import few, small_side

#: Teams, or policies, of one agent that are compared with each context in place.
MOST = 1000
_POLICY = "array<struct<policy_id:bigint,key:string,prefix:boolean,deny:boolean,above:boolean,priority:int,field_masks:array<string>>>"
WRITERS_OF_LAKE = ("system", "catalog_sync")


def agent_teams(visible: DataFrame, agent: str) -> DataFrame:
    """path, direct of one agent."""
    return visible.filter(F.col("agent_id") == agent).select("path", "direct")


def baseline(contexts: DataFrame, teams: DataFrame, agent: str) -> DataFrame:
    """Contexts with `baseline`, whether scope and owner alone let the agent read. user: never; datalake: all."""
    rows = few(teams.select("path").distinct(), MOST)
    if rows is not None:
        return contexts.withColumn("baseline", _sees(agent, [r.path for r in rows]))
    mine = teams.select(F.col("path").alias("owner_space"), F.lit(True).alias("__sees")).distinct()
    by_owner = F.when(F.col("scope") == "datalake", True).when(F.col("scope") == "agent", F.col("owner_space") == agent).when(F.col("scope") == "team", F.col("__sees"))
    return contexts.join(mine, "owner_space", "left").withColumn("baseline", F.coalesce(by_owner, F.lit(False))).drop("__sees").select(*contexts.columns, "baseline")


def _sees(agent: str, paths: list[str]) -> Column:
    owner = F.col("owner_space")
    return F.coalesce(F.when(F.col("scope") == "datalake", True).when(F.col("scope") == "agent", owner == agent).when(F.col("scope") == "team", owner.isin(paths) if paths else F.lit(False)), F.lit(False))


def match_like(uri: Column, pattern: Column) -> Column:
    """* anywhere stands for any characters; % and _ are ordinary ones."""
    return F.like(uri, F.replace(F.replace(F.replace(pattern, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%")))


def match_prefix(uri: Column, pattern: Column) -> Column:
    """Only a * at the end is special."""
    return F.when(pattern.endswith("*"), uri.startswith(F.expr("left(pattern, length(pattern) - 1)"))).otherwise(uri == pattern)


def policies_for(policies: DataFrame, teams: DataFrame, agent: str, action: str = "read") -> DataFrame:
    """Policies on an action whose principal is the agent or one of its teams; `above`: a team it is not in directly."""
    principals = teams.select(F.col("path").alias("principal"), (~F.col("direct")).alias("above"))
    mine = policies.sparkSession.createDataFrame([(agent, False)], "principal string, above boolean")
    return policies.filter(F.array_contains("actions", action)).join(principals.unionByName(mine), "principal")


def _matched(uris: DataFrame, policies: DataFrame) -> DataFrame:
    """uri with each policy that matches by B09, without comparing all pairs."""
    prefix = policies.filter(F.col("pattern").endswith("*")).withColumn("key", F.expr("left(pattern, length(pattern) - 1)"))
    exact = policies.filter(~F.col("pattern").endswith("*")).withColumn("key", F.col("pattern"))
    # a uri has few thousand characters at most, hence so many distinct lengths
    lengths = prefix.select(F.length("key").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))
    keyed = uris.join(F.broadcast(lengths)).select("uri", F.explode(F.array_distinct(F.transform(F.filter("lengths", lambda n: n <= F.length("uri")), lambda n: F.left("uri", n)))).alias("key"))
    return keyed.join(prefix, "key").unionByName(uris.withColumn("key", F.col("uri")).join(exact, "key"))


def decide(contexts: DataFrame, policies: DataFrame, teams: DataFrame, agent: str) -> DataFrame:
    """Contexts that are not deleted with `readable`, `reason` and `field_masks`.

    A deny by a team above comes first, then any deny, then the allow of highest priority (ties: smallest policy_id) with its masks,
    then the baseline.
    """
    own = few(teams.select("path", "direct"), MOST)
    if own is not None:
        near = policies.sparkSession.createDataFrame(own, "path string, direct boolean")
        mine = few(policies_for(policies, near, agent).select("policy_id", "pattern", "effect", "above", "priority", "field_masks"), MOST)
        if mine is not None:
            return _decided_in_place(contexts.filter("status <> 'deleted'").withColumn("baseline", _sees(agent, [r.path for r in own])), mine)
    live = baseline(contexts.filter("status <> 'deleted'"), teams, agent)
    mine = policies_for(policies, teams, agent)
    verdicts = _matched(live.select("uri").distinct(), mine).groupBy("uri").agg(
        F.bool_or((F.col("effect") == "deny") & F.col("above")).alias("__above"),
        F.bool_or(F.col("effect") == "deny").alias("__deny"),
        F.max(F.when(F.col("effect") == "allow", F.struct("priority", -F.col("policy_id"), "field_masks"))).alias("__allow"),
    )
    return _settle(live.join(verdicts, "uri", "left")).select(*contexts.columns, "reason", "readable", "field_masks")


def _decided_in_place(live: DataFrame, policies: list) -> DataFrame:
    """decide() with an agent's policies as one literal."""
    rows = [{"policy_id": p.policy_id, "key": p.pattern.removesuffix("*"), "prefix": p.pattern.endswith("*"), "deny": p.effect == "deny", "above": p.above, "priority": p.priority, "field_masks": p.field_masks} for p in policies if p.pattern is not None]
    uri = F.col("uri")
    hits = F.filter(F.from_json(F.lit(json.dumps(rows)), _POLICY), lambda p: F.when(p["prefix"], uri.startswith(p["key"])).otherwise(uri == p["key"]))
    best = F.array_max(F.transform(F.filter("__hits", lambda p: ~p["deny"]), lambda p: F.struct(p["priority"].alias("priority"), (-p["policy_id"]).alias("first"), p["field_masks"].alias("field_masks"))))
    judged = live.withColumn("__hits", hits).withColumns({"__above": F.exists("__hits", lambda p: p["deny"] & p["above"]), "__deny": F.exists("__hits", lambda p: p["deny"]), "__allow": best})
    return _settle(judged.drop("__hits"))


def _settle(joined: DataFrame) -> DataFrame:
    reason = F.when(F.col("__above"), "parent team deny").when(F.col("__deny"), "explicit deny").when(F.col("__allow").isNotNull(), "explicit allow").when(F.col("baseline"), "baseline").otherwise("no access")
    allowed = F.col("reason").isin("explicit allow", "baseline")
    return joined.withColumn("reason", reason).withColumns({"readable": allowed, "field_masks": F.when(F.col("reason") == "explicit allow", F.col("__allow.field_masks"))}).drop("__above", "__deny", "__allow", "baseline")


def decide_one(contexts: DataFrame, policies: DataFrame, teams: DataFrame, agent: str, uri: str) -> DataFrame:
    """The decision on a single uri, where * in a pattern may stand anywhere."""
    row = baseline(contexts.filter((F.col("uri") == uri) & (F.col("status") != "deleted")), teams, agent)
    mine = policies_for(policies, teams, agent).filter(match_like(F.lit(uri), F.col("pattern")))
    verdict = mine.agg(
        F.bool_or((F.col("effect") == "deny") & F.col("above")).alias("__above"), F.bool_or(F.col("effect") == "deny").alias("__deny"),
        F.max(F.when(F.col("effect") == "allow", F.struct("priority", -F.col("policy_id"), "field_masks"))).alias("__allow"),
    ).withColumn("uri", F.lit(uri))
    return _settle(row.join(verdict, "uri", "left"))


def readable(contexts: DataFrame, policies: DataFrame, teams: DataFrame, agent: str) -> DataFrame:
    return decide(contexts, policies, teams, agent).filter("readable").drop("readable", "reason")


def legacy_visible(contexts: DataFrame, teams: DataFrame, agent: str) -> DataFrame:
    """The baseline without policies."""
    return baseline(contexts, teams, agent).filter("baseline").drop("baseline")


def writable(contexts: DataFrame, visible: DataFrame, memberships: DataFrame, team_table: DataFrame, agent: str) -> DataFrame:
    """Contexts with `writable`. Policies are never asked; of teams only a direct membership with read_write counts."""
    direct = memberships.filter((F.col("agent_id") == agent) & (F.col("access") == "read_write")).join(team_table, F.col("team_id") == F.col("id"))
    mine = small_side(direct.select(F.col("path").alias("owner_space"), F.lit(True).alias("__writes")).distinct(), MOST)
    rule = F.when(F.col("scope") == "agent", F.col("owner_space") == agent).when(F.col("scope") == "datalake", F.lit(agent in WRITERS_OF_LAKE)).when(F.col("scope") == "team", F.col("__writes"))
    return contexts.join(mine, "owner_space", "left").withColumn("writable", F.coalesce(rule, F.lit(False))).select(*contexts.columns, "writable")


def admins(memberships: DataFrame, team_table: DataFrame) -> DataFrame:
    """Agents that are admin of some team."""
    return memberships.filter("role = 'admin'").join(team_table, F.col("team_id") == F.col("id"), "left_semi").select("agent_id").distinct()


def grants(commands: DataFrame) -> DataFrame:
    """Share commands (seq, kind grant or revoke, uri, principal, field_masks) reduced to the grants in force. The latest
    command on (uri, principal) decides."""
    last = commands.groupBy("uri", "principal").agg(F.max_by(F.struct("kind", "field_masks"), "seq").alias("last"))
    return last.filter("last.kind = 'grant'").select("uri", "principal", F.col("last.field_masks").alias("field_masks"))


# Fixed value: what marks a policy as a share in its conditions.
SHARE = '{"kind": "share_grant"}'


def shares(commands: DataFrame, contexts: DataFrame) -> DataFrame:
    """Share commands (seq, kind, uri, principal, field_masks) with `error`: 404 no such context, 403 where its `writable` (L03) says no."""
    rows = contexts.filter("status <> 'deleted'").select("uri", F.col("writable").alias("__writes"))
    return commands.join(rows, "uri", "left").withColumn("error", F.when(F.col("__writes").isNull(), 404).when(~F.col("__writes"), 403)).drop("__writes")


def share_policies(grants: DataFrame) -> DataFrame:
    """The grants in force as allow policies, marked by their conditions."""
    return grants.select(F.col("uri").alias("pattern"), "principal", F.lit("allow").alias("effect"), F.array(F.lit("read")).alias("actions"), "field_masks", F.lit(0).alias("priority"), F.lit(SHARE).alias("conditions"))


def is_share(conditions: Column) -> Column:
    """Conditions hold the mark of a share, whatever else they hold."""
    return F.coalesce(F.get_json_object(conditions, "$.kind") == "share_grant", F.lit(False))


def listed_policies(policies: DataFrame, principal: str | None = None, pattern: str | None = None, effect: str | None = None, most: int = 1000) -> DataFrame:
    """Policies by exact principal, pattern, effect; highest priority first, a page of them, with their `place`."""
    for column, value in (("principal", principal), ("pattern", pattern), ("effect", effect)):
        if value is not None:
            policies = policies.filter(F.col(column) == value)
    order = (F.desc("priority"), F.col("policy_id"))
    return policies.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def upserted(commands: DataFrame, key: list[str]) -> DataFrame:
    """Upsert and delete commands (seq, op, columns) reduced to the rows in force: the latest of each key, if no delete."""
    rest = [c for c in commands.columns if c not in (*key, "seq", "op")]
    last = commands.groupBy(*key).agg(F.max_by(F.struct("op", *rest), "seq").alias("last"))
    return last.filter("last.op <> 'delete'").select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])

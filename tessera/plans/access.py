"""Queries of access control (L), contexts and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import access as ops
from ..operators import access_all
from ..operators import contexts as rows
from ..sources import tables
from . import common
from .common import ACCOUNT, AGENT, MINE

QUERIES, ORACLES, query = common.book()
_TENANT = f"tenant AS (SELECT * FROM contexts WHERE account_id = '{ACCOUNT}')"
_MASKS = "array_join(field_masks, ',') AS masks"


def _teams(spark, sf_dir):
    return ops.agent_teams(common.visible(spark, sf_dir), AGENT)


@query("C02_visible_teams", "SELECT agent_id, path, bool_or(direct) AS direct FROM visible GROUP BY agent_id, path")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.visible(spark, sf_dir)


@query("G02_ancestor_teams", "SELECT agent_id, path FROM visible GROUP BY agent_id, path HAVING NOT bool_or(direct)")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.visible(spark, sf_dir).filter("not direct").select("agent_id", "path")


@query("L10_legacy_visible", f"""{tables.VIEWS}, {MINE} SELECT id FROM contexts WHERE account_id = '{ACCOUNT}' AND (scope = 'datalake' OR scope = 'agent' AND owner_space = '{AGENT}' OR scope = 'team' AND owner_space IN (SELECT path FROM mine))""")
def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.legacy_visible(common.contexts(spark, sf_dir), _teams(spark, sf_dir), AGENT).select("id")


@query("L03_writable", f"""SELECT id, coalesce(CASE scope WHEN 'agent' THEN owner_space = '{AGENT}' WHEN 'team' THEN owner_space IN (SELECT path FROM memberships JOIN teams ON teams.id = team_id WHERE agent_id = '{AGENT}' AND access = 'read_write') END, false) AS writable
  FROM contexts WHERE account_id = '{ACCOUNT}'""")  # fmt: skip
def writable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.writable(common.contexts(spark, sf_dir), common.visible(spark, sf_dir), tables.memberships(spark, sf_dir), tables.teams(spark, sf_dir), AGENT).select("id", "writable")


@query("L05_decisions", f"{tables.VIEWS}, {MINE}, {_TENANT}, {common.decided('tenant')} SELECT id, uri, reason, array_to_string(field_masks, ',') AS masks FROM decided")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.decide(common.contexts(spark, sf_dir), tables.policies(spark, sf_dir), _teams(spark, sf_dir), AGENT).select("id", "uri", "reason", F.expr(_MASKS))


@query("L06_masked", f"{tables.VIEWS}, {MINE}, {_TENANT}, {common.decided('tenant')} SELECT id, {common.masked('l1_content')} AS l1_content FROM decided WHERE reason IN ('explicit allow', 'baseline')")
def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = ops.readable(common.contexts(spark, sf_dir), tables.policies(spark, sf_dir), _teams(spark, sf_dir), AGENT)
    return seen.select("id", text.masked(F.col("l1_content"), F.col("field_masks")).alias("l1_content"))


_ONE = "ctx://agent/agent-3/memories/m33"


@query("L04_single_decision", f"""{tables.VIEWS}, {MINE}, principals AS (SELECT path AS principal, NOT direct AS above FROM mine UNION ALL SELECT '{AGENT}', false),
one AS (SELECT * FROM contexts WHERE account_id = '{ACCOUNT}' AND uri = '{_ONE}' AND status <> 'deleted'),
hit AS (SELECT bool_or(effect = 'deny' AND above) AS a, bool_or(effect = 'deny') AS d, max(struct_pack(p := priority, i := -policy_id, m := field_masks)) FILTER (WHERE effect = 'allow') AS w FROM policies JOIN principals USING (principal)
  WHERE list_contains(actions, 'read') AND '{_ONE}' LIKE replace(replace(replace(pattern, '%', '\\%'), '_', '\\_'), '*', '%') ESCAPE '\\')
SELECT uri, CASE WHEN a THEN 'parent team deny' WHEN d THEN 'explicit deny' WHEN w IS NOT NULL THEN 'explicit allow' WHEN owner_space = '{AGENT}' THEN 'baseline' ELSE 'no access' END AS reason, array_to_string(w.m, ',') AS masks FROM one, hit""")  # fmt: skip
def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.decide_one(common.contexts(spark, sf_dir), tables.policies(spark, sf_dir), _teams(spark, sf_dir), AGENT, _ONE).select("uri", "reason", F.expr(_MASKS))


@query("B21_admins", "SELECT DISTINCT agent_id FROM memberships JOIN teams ON teams.id = team_id WHERE role = 'admin'")
def admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.admins(tables.memberships(spark, sf_dir), tables.teams(spark, sf_dir))


@query("L08_grants", """, cmd AS (SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'grant' ELSE 'revoke' END AS kind, 'ctx://team/docs/d' || user_id AS uri, 'agent-' || event_id % 10 AS principal FROM events)
SELECT uri, principal FROM (SELECT *, row_number() OVER (PARTITION BY uri, principal ORDER BY seq DESC) AS rn FROM cmd) WHERE rn = 1 AND kind = 'grant'""")  # fmt: skip
def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    cmd = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view", "signup"), "grant").otherwise("revoke").alias("kind"), F.concat(F.lit("ctx://team/docs/d"), "user_id").alias("uri"), F.concat(F.lit("agent-"), F.col("event_id") % 10).alias("principal"), F.lit(None).cast("array<string>").alias("field_masks"))
    return ops.grants(cmd).select("uri", "principal")


@query("L07_policy_upserts", """, cmd AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id AS policy_id, event_type AS effect FROM events)
SELECT policy_id, effect FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY seq DESC) AS rn FROM cmd) WHERE rn = 1 AND op <> 'delete'""")  # fmt: skip
def policy_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    return ops.upserted(e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").alias("policy_id"), F.col("event_type").alias("effect")), ["policy_id"])


_CREATES = """SELECT doc_id AS seq, CASE WHEN doc_id % 5 < 4 THEN 'acme' ELSE 'beta' END AS account_id,
  CASE doc_id % 6 WHEN 0 THEN 'ctx://team/docs/d' || doc_id WHEN 1 THEN 'ctx://agent/agent-1/x' || doc_id // 10 WHEN 2 THEN 'ctx://datalake/new/' || doc_id WHEN 3 THEN 'ctx://user/u/' || doc_id WHEN 4 THEN 'ctx://agent/agent-1/memories/m' || (doc_id + 1) ELSE 'ctx://datalake/new/z' || doc_id END AS uri,
  CASE doc_id % 6 WHEN 0 THEN 'team' WHEN 1 THEN 'agent' WHEN 2 THEN 'datalake' WHEN 3 THEN 'user' WHEN 4 THEN 'agent' ELSE 'datalake' END AS scope,
  CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'agent-1' WHEN 2 THEN NULL WHEN 3 THEN 'u' WHEN 4 THEN 'agent-1' ELSE 'x' END AS owner_space FROM documents"""


@query("M01_creates", f""", cmd AS ({_CREATES}), checked AS (SELECT seq, account_id, uri,
  CASE WHEN scope = 'user' OR (scope = 'datalake' AND owner_space IS NOT NULL) OR (scope IN ('agent', 'team') AND owner_space IS NULL)
    OR NOT starts_with(uri, CASE scope WHEN 'team' THEN CASE WHEN owner_space = '' THEN 'ctx://team/' ELSE 'ctx://team/' || owner_space || '/' END WHEN 'agent' THEN 'ctx://agent/' || owner_space || '/' ELSE 'ctx://datalake/' END) THEN 400
    WHEN EXISTS (SELECT 1 FROM contexts c WHERE c.account_id = cmd.account_id AND c.uri = cmd.uri) OR seq <> min(seq) OVER (PARTITION BY account_id, uri) THEN 409 END AS error FROM cmd)
SELECT seq, error::INT AS error FROM checked""")  # fmt: skip
def creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd = spark.sql(_CREATES.replace("doc_id // 10", "(doc_id div 10)").replace("FROM documents", "FROM {documents}"), documents=tables.read(spark, sf_dir, "documents"))
    return rows.created(cmd, tables.contexts(spark, sf_dir)).select("seq", "error")


@query("M02_updates", """, cmd AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_id % 17 = 0 THEN 'delete' ELSE 'update' END AS op, (event_id % 5 + 1)::INT AS expected, 'new ' || event_id AS content FROM events),
run AS (SELECT id, version, status, l2_content AS content, -1::BIGINT AS seq FROM contexts WHERE id IN (SELECT id FROM cmd)
  UNION ALL SELECT r.id, CASE WHEN c.op = 'delete' THEN r.version ELSE r.version + 1 END, CASE WHEN c.op = 'delete' THEN 'deleted' WHEN r.status = 'stale' THEN 'active' ELSE r.status END, CASE WHEN c.op = 'delete' THEN r.content ELSE c.content END, c.seq
  FROM run r JOIN LATERAL (SELECT * FROM cmd WHERE cmd.id = r.id AND cmd.seq > r.seq AND cmd.expected = r.version ORDER BY seq LIMIT 1) c ON true WHERE r.status <> 'deleted')
SELECT c.id, coalesce(l.version, c.version) AS version, coalesce(l.status, c.status) AS status FROM contexts c LEFT JOIN (SELECT id, arg_max(version, seq) AS version, arg_max(status, seq) AS status FROM run GROUP BY id) l USING (id)""")  # fmt: skip
def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    cmd = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 17 == 0, "delete").otherwise("update").alias("op"), (F.col("event_id") % 5 + 1).cast("int").alias("expected"), F.concat(F.lit("new "), "event_id").alias("content"))
    return rows.updated(tables.contexts(spark, sf_dir), cmd).select("id", "version", "status")


@query("M06_stat", f"SELECT id, uri, context_type, scope, owner_space, status, version FROM contexts WHERE uri = '{_ONE}' AND status <> 'deleted'")
def stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.stat(tables.contexts(spark, sf_dir), _ONE).select("id", "uri", "context_type", "scope", "owner_space", "status", "version")


@query("M07_memories", f"{tables.VIEWS}, {MINE}, {_TENANT}, {common.decided('tenant')} SELECT id, uri, last_accessed_at FROM decided WHERE context_type = 'memory' AND reason IN ('explicit allow', 'baseline')")
def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.memories(common.contexts(spark, sf_dir), tables.policies(spark, sf_dir), _teams(spark, sf_dir), AGENT)
    return out.withColumn("last_accessed_at", F.col("last_accessed_at").cast("timestamp_ntz"))


@query("M07_promotions", """SELECT 'ctx://team/' || CASE WHEN c_custkey % 2 = 0 THEN 'memories' ELSE 'asia' END || '/shared_knowledge/m' || id AS uri, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'asia' END AS owner_space, id AS derived_from
  FROM contexts JOIN customer ON c_custkey = id WHERE context_type = 'memory' AND scope = 'agent' AND status <> 'deleted'""")  # fmt: skip
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("asia").alias("team"))
    return rows.promoted(tables.contexts(spark, sf_dir), cmd)[0].select("uri", "owner_space", "derived_from")


@query("M22_children", f"{tables.VIEWS}, {MINE}, {_TENANT}, {common.decided('tenant')} SELECT DISTINCT split_part(substr(uri, length('ctx://agent/') + 1), '/', 1) AS name FROM decided WHERE uri LIKE 'ctx://agent/%' AND reason IN ('explicit allow', 'baseline')")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.children(common.contexts(spark, sf_dir), "ctx://agent", tables.policies(spark, sf_dir), _teams(spark, sf_dir), AGENT)


@query("B01_level", "SELECT id, uri, coalesce(l1_content, '') AS content FROM contexts WHERE status <> 'deleted'")
def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.projected(tables.contexts(spark, sf_dir).filter("status <> 'deleted'"), "L1")


_EVERYONE = f""", agents AS (SELECT DISTINCT agent_id FROM memberships),
seen AS (SELECT agent_id, path, bool_or(direct) AS direct FROM visible GROUP BY agent_id, path),
principals AS (SELECT agent_id, path AS principal, NOT direct AS above FROM seen UNION ALL SELECT agent_id, agent_id, false FROM agents),
met AS (SELECT c.uri, p.* FROM contexts c JOIN policies p ON CASE WHEN ends_with(pattern, '*') THEN starts_with(uri, left(pattern, -1)) ELSE uri = pattern END WHERE list_contains(actions, 'read')),
hits AS (SELECT agent_id, uri, bool_or(effect = 'deny' AND above) AS a, bool_or(effect = 'deny') AS d, max(struct_pack(p := priority, i := -policy_id, m := field_masks)) FILTER (WHERE effect = 'allow') AS w FROM met JOIN principals USING (principal) GROUP BY agent_id, uri),
verdicts AS (SELECT g.agent_id, c.uri, h.w, CASE WHEN h.a THEN 'parent team deny' WHEN h.d THEN 'explicit deny' WHEN h.w IS NOT NULL THEN 'explicit allow'
    WHEN coalesce(CASE scope WHEN 'datalake' THEN true WHEN 'agent' THEN owner_space = g.agent_id WHEN 'team' THEN s.path IS NOT NULL END, false) THEN 'baseline' ELSE 'no access' END AS reason
  FROM agents g CROSS JOIN contexts c LEFT JOIN hits h ON h.agent_id = g.agent_id AND h.uri = c.uri LEFT JOIN seen s ON s.agent_id = g.agent_id AND s.path = c.owner_space WHERE c.status <> 'deleted')"""


@query("L05_reasons_by_uri", f"{_EVERYONE} SELECT uri, reason, count(*) AS n_agents FROM verdicts GROUP BY uri, reason")
def reasons_by_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all agents may read each context, and why."""
    return access_all.reasons_by_uri(tables.contexts(spark, sf_dir), tables.policies(spark, sf_dir), common.visible(spark, sf_dir), tables.memberships(spark, sf_dir))


@query("L05_requests", f"""{_EVERYONE}, asked AS (SELECT event_id AS request_id, 'agent-' || event_id % 40 AS agent_id, uri FROM events JOIN contexts ON id = user_id)
SELECT request_id, agent_id, uri, reason, reason IN ('explicit allow', 'baseline') AS readable, CASE WHEN reason = 'explicit allow' THEN array_to_string(w.m, ',') END AS masks FROM asked JOIN verdicts USING (agent_id, uri)""")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request of an agent for a context, decided by that agent's teams and policies."""
    every = tables.contexts(spark, sf_dir)
    asked = tables.events(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.concat(F.lit("agent-"), F.col("event_id") % 40).alias("agent_id"), F.col("user_id").alias("id")).join(every.select("id", "uri"), "id")
    members = tables.memberships(spark, sf_dir).select("agent_id").distinct()
    decided = access_all.decide_requests(asked.join(members, "agent_id", "left_semi"), every, tables.policies(spark, sf_dir), common.visible(spark, sf_dir))
    return decided.select("request_id", "agent_id", "uri", "reason", "readable", F.array_join("field_masks", ",").alias("masks"))

"""Queries of the write path: refused and accepted commands (M01-M03, M07, L08, B11, B13), files (A09), audit (A12, I14), vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import access, audit, command_log, contexts, propagation, retrieval, sections
from ..sources import tables
from . import common
from . import retrieval as searches
from .access import _CREATES
from .common import AGENT

QUERIES, ORACLES, query = common.book()
_WRITES = f"""coalesce(CASE scope WHEN 'agent' THEN owner_space = '{AGENT}' WHEN 'team' THEN owner_space IN (SELECT path FROM memberships JOIN teams ON teams.id = team_id WHERE agent_id = '{AGENT}' AND access = 'read_write') ELSE false END, false)"""
_CHECKED = f"""cmd AS ({_CREATES}), checked AS (SELECT seq, account_id, uri,
  CASE WHEN scope = 'user' OR (scope = 'datalake' AND owner_space IS NOT NULL) OR (scope IN ('agent', 'team') AND owner_space IS NULL)
    OR NOT starts_with(uri, CASE scope WHEN 'team' THEN CASE WHEN owner_space = '' THEN 'ctx://team/' ELSE 'ctx://team/' || owner_space || '/' END WHEN 'agent' THEN 'ctx://agent/' || owner_space || '/' ELSE 'ctx://datalake/' END) THEN 400
    WHEN NOT {_WRITES} THEN 403
    WHEN EXISTS (SELECT 1 FROM contexts c WHERE c.account_id = cmd.account_id AND c.uri = cmd.uri) OR seq <> min(seq) OVER (PARTITION BY account_id, uri) THEN 409 END AS error FROM cmd)"""


def _writable(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return access.writable(rows, common.visible(spark, sf_dir), tables.memberships(spark, sf_dir), tables.teams(spark, sf_dir), AGENT)


def _creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd = spark.sql(_CREATES.replace("doc_id // 10", "(doc_id div 10)").replace("FROM documents", "FROM {documents}"), documents=tables.read(spark, sf_dir, "documents"))
    return contexts.created(_writable(spark, sf_dir, cmd), tables.contexts(spark, sf_dir))


@query("M01_checked_creates", f""", {_CHECKED} SELECT seq, error::INT AS error FROM checked""")
def checked_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _creates(spark, sf_dir).select("seq", "error")


@query("M01_created_events", f""", {_CHECKED} SELECT seq, uri, 'created' AS change_type FROM checked WHERE error IS NULL""")
def created_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.events_of(_creates(spark, sf_dir), "created")


_COMMANDS = """cmd AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_id % 17 = 0 THEN 'delete' ELSE 'update' END AS op, CASE WHEN event_id % 13 > 0 THEN (event_id % 3 + 1)::INT END AS expected, event_id % 19 = 0 AS sets_status FROM events)"""


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return tables.events(spark, sf_dir).select(n.alias("seq"), F.col("user_id").alias("id"), F.when(n % 17 == 0, "delete").otherwise("update").alias("op"), F.when(n % 13 > 0, n % 3 + 1).cast("int").alias("expected"), (n % 19 == 0).alias("sets_status"))


@query("M02_refusals", f""", {_COMMANDS} SELECT seq, CASE WHEN op = 'update' AND expected IS NULL THEN 428 WHEN op = 'update' AND sets_status THEN 400 WHEN c.id IS NULL OR c.status = 'deleted' THEN 404
  WHEN NOT {_WRITES} THEN 403 WHEN op = 'update' AND context_type = 'skill' THEN 400 WHEN expected <> version THEN 409 END::INT AS error FROM cmd LEFT JOIN contexts c USING (id)""")  # fmt: skip
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.refusals(_writable(spark, sf_dir, tables.contexts(spark, sf_dir)), _updates(spark, sf_dir)).select("seq", "error")


@query("M03_level_writes", """, cmd AS (SELECT event_id AS seq, user_id AS id, 'L' || event_id % 2 AS level, 'text ' || event_id AS content FROM events),
n AS (SELECT id, count(*) AS n, max_by(content, seq) FILTER (WHERE level = 'L0') AS l0, max_by(content, seq) FILTER (WHERE level = 'L1') AS l1 FROM cmd GROUP BY id)
SELECT c.id, CASE WHEN status <> 'deleted' THEN coalesce(l0, l0_content) ELSE l0_content END AS l0_content, CASE WHEN status <> 'deleted' THEN coalesce(l1, l1_content) ELSE l1_content END AS l1_content,
  (version + CASE WHEN status <> 'deleted' THEN coalesce(n, 0) ELSE 0 END)::INT AS version FROM contexts c LEFT JOIN n USING (id)""")  # fmt: skip
def level_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    cmd = tables.events(spark, sf_dir).select(n.alias("seq"), F.col("user_id").alias("id"), F.concat(F.lit("L"), n % 2).alias("level"), F.concat(F.lit("text "), n).alias("content"))
    return contexts.levels_written(tables.contexts(spark, sf_dir), cmd).select("id", "l0_content", "l1_content", "version")


@query("M07_added_memories", "SELECT 'ctx://agent/agent-' || doc_id % 10 || '/memories/n' || doc_id AS uri, 'agent-' || doc_id % 10 AS owner_space, left(text, 80) AS l0_content, left(text, 300) AS l1_content, 1::INT AS version FROM documents")
def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    cmd = tables.read(spark, sf_dir, "documents").select(F.concat(F.lit("agent-"), key % 10).alias("agent_id"), F.concat(F.lit("n"), key).alias("name"), "text")
    return contexts.memories_added(cmd).select("uri", "owner_space", "l0_content", "l1_content", "version")


@query("A09_level2", "SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 9 > 0 THEN 'file ' || id END ELSE l2_content END AS content, CASE WHEN id % 9 = 0 THEN 404 END::INT AS error FROM contexts")
def level2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.contexts(spark, sf_dir)
    path = F.concat(F.lit("/f/"), "id")
    files = c.filter("id % 9 > 0").select(path.alias("path"), F.concat(F.lit("file "), "id").alias("text"))
    return contexts.level2(c.withColumn("file_path", F.when(F.col("id") % 3 == 0, path)), files)


_SHARES = """cmd AS (SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'grant' ELSE 'revoke' END AS kind, c.uri AS shared, coalesce(c.uri, 'ctx://none') AS uri, 'agent-' || event_id % 10 AS principal,
  CASE WHEN event_id % 3 = 0 THEN ['the', 'k' || event_id % 4] END AS field_masks, c.status, c.scope, c.owner_space FROM events LEFT JOIN contexts c ON c.id = user_id)"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rows = F.col("event_id"), _writable(spark, sf_dir, tables.contexts(spark, sf_dir))
    e = tables.events(spark, sf_dir).join(rows.select(F.col("id").alias("user_id"), "uri"), "user_id", "left")
    cmd = e.select(n.alias("seq"), F.when(F.col("event_type").isin("click", "view", "signup"), "grant").otherwise("revoke").alias("kind"), F.coalesce("uri", F.lit("ctx://none")).alias("uri"), F.concat(F.lit("agent-"), n % 10).alias("principal"), F.when(n % 3 == 0, F.array(F.lit("the"), F.concat(F.lit("k"), n % 4))).alias("field_masks"))
    return access.shares(cmd, rows)


@query("L08_share_errors", f""", {_SHARES} SELECT seq, CASE WHEN shared IS NULL OR status = 'deleted' THEN 404 WHEN NOT {_WRITES} THEN 403 END::INT AS error FROM cmd""")
def share_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).select("seq", "error")


@query("L09_share_policies", f""", {_SHARES}, ok AS (SELECT * FROM cmd WHERE shared IS NOT NULL AND status <> 'deleted' AND {_WRITES}),
l AS (SELECT *, row_number() OVER (PARTITION BY uri, principal ORDER BY seq DESC) AS rn FROM ok)
SELECT uri AS pattern, principal, array_to_string(field_masks, ',') AS masks FROM l WHERE rn = 1 AND kind = 'grant'""")  # fmt: skip
def share_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_force = access.share_policies(access.grants(_shares(spark, sf_dir).filter("error is null")))
    others = in_force.withColumn("conditions", F.lit('{"kind": "other"}')).unionByName(in_force.withColumn("conditions", F.lit(None).cast("string")))
    return in_force.unionByName(others).filter(access.is_share(F.col("conditions"))).select("pattern", "principal", F.array_join("field_masks", ",").alias("masks"))


#: Policies as suppliers state them: one each, for ten agents.
_STATED = "stated AS (SELECT s_suppkey AS policy_id, 'agent-' || s_suppkey % 10 AS principal, CASE WHEN s_suppkey % 3 = 0 THEN 'deny' ELSE 'allow' END AS effect, (s_suppkey % 7)::INT AS priority, [['read'], ['read', 'write'], ['write', 'share'], []][s_suppkey % 4 + 1] AS actions FROM supplier)"


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    actions = [F.array(*[F.lit(a) for a in kinds]).cast("array<string>") for kinds in (("read",), ("read", "write"), ("write", "share"), ())]
    return tables.read(spark, sf_dir, "supplier").select(key.alias("policy_id"), F.concat(F.lit("agent-"), key % 10).alias("principal"), F.when(key % 3 == 0, "deny").otherwise("allow").alias("effect"), (key % 7).cast("int").alias("priority"), F.element_at(F.array(*actions), (key % 4 + 1).cast("int")).alias("actions"))


@query("B13_policy_list", f"WITH {_STATED} SELECT policy_id, row_number() OVER (ORDER BY priority DESC, policy_id)::INT AS place FROM stated WHERE effect = 'allow' AND principal = '{AGENT}' ORDER BY place LIMIT 1000")
def policy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.listed_policies(_stated(spark, sf_dir), principal=AGENT, effect="allow").select("policy_id", "place")


@query("A12_audit_tiers", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'best_effort' ELSE 'denied' END AS tier, CASE WHEN event_id % 2 = 0 THEN props END AS metadata FROM events")
def audit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{}").alias("metadata"))
    out = [audit.entries(rows.filter(F.col("event_id") % 3 == i), tier) for i, tier in enumerate(audit.TIERS)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("I14_audit_rows", f"{searches.FOUND} SELECT 'r-1' AS retrieval_id, '{AGENT}' AS actor, uri AS resource_uri, place FROM result")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.audit_rows(searches.found(spark, sf_dir), "r-1", AGENT, common.QUERY, tables.as_of()).select("retrieval_id", "actor", "resource_uri", "place")


@query("I18_vectors_kept", """, cmd AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN [1.0, 2.0] ELSE list_transform(embedding, lambda x: x::DOUBLE * 0 + vec_id) END AS v FROM embeddings WHERE vec_id % 2 = 1),
j AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS embedding, cmd.vec_id IS NOT NULL AS told, v, coalesce(c.status IN ('archived', 'deleted'), false) AS gone FROM embeddings e LEFT JOIN cmd USING (vec_id) LEFT JOIN contexts c ON c.id = e.vec_id)
SELECT vec_id, CASE WHEN told AND len(v) <> 64 THEN 400 END::INT AS error, CASE WHEN gone THEN NULL WHEN told AND (v IS NULL OR len(v) = 64) THEN round(v[1], 6) ELSE round(embedding[1], 6) END AS first FROM j""")  # fmt: skip
def vectors_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = F.col("vec_id")
    new = F.when(n % 7 == 0, None).when(n % 11 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.transform("embedding", lambda x: x * 0 + n))
    out = retrieval.vectors_kept(v, v.filter(n % 2 == 1).select(F.lit(1).alias("seq"), "vec_id", new.alias("embedding")), tables.contexts(spark, sf_dir), 64)
    return out.select("vec_id", "error", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("H54_flags", "SELECT event_id, coalesce(k % 5 <> 1 AND k % 2 = 0, false) AS breaking FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events)")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the metadata is no JSON there is no flag."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = tables.read(spark, sf_dir, "events").select("event_id", F.when(k % 5 == 1, "no json").otherwise(F.to_json(F.struct((k % 2 == 0).alias("is_breaking")))).alias("metadata"))
    return rows.select("event_id", text.flag(F.col("metadata"), "is_breaking").alias("breaking"))


@query("H23_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select("event_id", text.iso8601(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")).alias("at"))


@query("H41_subsets", f"WITH {_STATED} SELECT policy_id, list_has_all(['read', 'write'], actions) AS known, coalesce(list_position(actions, 'write'), 0)::BIGINT AS at, len(actions)::INT AS n FROM stated")
def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _stated(spark, sf_dir)
    return p.select("policy_id", text.holds_all(F.array(F.lit("read"), F.lit("write")), F.col("actions")).alias("known"), F.array_position("actions", "write").alias("at"), F.size("actions").alias("n"))


@query("H18_lock_keys", """SELECT id, (CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END)::BIGINT AS key FROM (SELECT id, ('0x' || left(sha256(account_id || chr(0) || uri), 16))::UBIGINT::HUGEINT AS x FROM contexts)""")
def lock_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.contexts(spark, sf_dir).select("id", text.lock_key(F.concat("account_id", F.lit("\0"), "uri")).alias("key"))


@query("H53_keyword_groups", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'ab+k' || doc_id || '/cd' END AS groups FROM documents""")
def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    said = F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.concat(F.lit('Groups: [["AB ", "k'), key, F.lit('", "x"], ["cd"], ["cd"], ["y"]] end')))
    groups = text.keyword_groups(said)
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(groups, lambda g: F.array_join(g, "+")), "/").alias("groups"))


@query("H52_first_objects", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"a":' || doc_id || '}' WHEN 1 THEN '{"b":[1]}' END AS found FROM documents""")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    said = F.when(n % 3 == 0, F.concat(F.lit('Sure:\n```json\n{"a":'), n, F.lit("}\n```\nDone."))).when(n % 3 == 1, 'so {"b":[1]} it is').otherwise("{broken")
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.first_object(said).alias("found"))


@query("J11_ingest_errors", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 400 WHEN doc_id % 7 = 0 THEN 409 END::INT AS error FROM documents")
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    asked = tables.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(n % 4 == 0, "ctx://team/").otherwise("ctx://resources/"), n).alias("uri"))
    there = asked.filter(n % 7 == 0).select("uri")
    return sections.ingestible(asked, there).select("doc_id", "error")


@query("N07_backoff", "SELECT event_id, least(300, (event_id % 80) * 5)::INT AS seconds FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select("event_id", propagation.scores.backoff_seconds(F.col("event_id") % 80).cast("int").alias("seconds"))


#: A third of all commands are updates of one row, which expects each version several times; every sixth row may not be written.
_HOT = 7
_SEQUENCE = f""", cmd AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN {_HOT} ELSE user_id END AS id, CASE WHEN event_id % 17 = 0 AND event_id % 3 > 0 THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN event_id % 3 = 0 THEN 2 + event_id // 30 WHEN event_id % 13 > 0 THEN event_id % 7 + 1 END AS expected, event_id % 19 = 0 AS sets_status, 'new ' || event_id AS content FROM events),
judged AS (SELECT cmd.*, c.version, c.context_type = 'skill' AND op = 'update' AS blocked, CASE WHEN expected IS NULL THEN 428 WHEN op = 'update' AND sets_status THEN 400 WHEN c.id IS NULL OR c.status = 'deleted' THEN 404 WHEN c.id % 6 = 0 THEN 403 END AS fixed
  FROM cmd LEFT JOIN contexts c USING (id)),
good AS (SELECT * FROM judged WHERE fixed IS NULL AND NOT blocked),
run AS (SELECT DISTINCT id, version::BIGINT AS now, -1::BIGINT AS seq, false AS gone FROM judged WHERE fixed IS NULL
  UNION ALL SELECT r.id, r.now + 1, g.seq, g.op = 'delete' FROM run r JOIN LATERAL (SELECT * FROM good WHERE good.id = r.id AND good.seq > r.seq AND good.expected = r.now ORDER BY seq LIMIT 1) g ON true WHERE NOT r.gone),
coded AS (SELECT j.seq, j.id, j.op, j.content, CASE WHEN fixed IS NOT NULL THEN fixed WHEN took.seq IS NOT NULL THEN NULL WHEN r.gone THEN 404 WHEN blocked THEN 400 ELSE 409 END::INT AS error, took.now AS version_after
  FROM judged j ASOF LEFT JOIN run r ON r.id = j.id AND j.seq > r.seq LEFT JOIN run took ON took.id = j.id AND took.seq = j.seq)"""


def _sequence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contexts, commands, and the commands' results."""
    n, hot = F.col("event_id"), F.col("event_id") % 3 == 0
    cmd = tables.events(spark, sf_dir).select(
        n.alias("seq"), F.when(hot, _HOT).otherwise(F.col("user_id")).alias("id"), F.when((n % 17 == 0) & ~hot, "delete").otherwise("update").alias("op"),
        F.when(hot, 2 + F.expr("event_id div 30")).when(n % 13 > 0, n % 7 + 1).alias("expected"), (n % 19 == 0).alias("sets_status"), F.concat(F.lit("new "), n).alias("content"),
    )
    rows = tables.contexts(spark, sf_dir)
    return rows, cmd, command_log.sequenced(rows.withColumn("writable", F.col("id") % 6 != 0), cmd)


@query("M02_sequence", f"{_SEQUENCE} SELECT seq, error, version_after FROM coded")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by running version."""
    return _sequence(spark, sf_dir)[2].select("seq", "error", "version_after")


@query("M04_sequence_events", f"{_SEQUENCE} SELECT seq, id, CASE op WHEN 'delete' THEN 'deleted' ELSE 'modified' END AS change_type FROM coded WHERE error IS NULL")
def sequence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cmd, results = _sequence(spark, sf_dir)
    return command_log.events(results, cmd)


@query("M02_sequence_applied", f"""{_SEQUENCE}, last AS (SELECT id, max(version_after) AS v, bool_or(op = 'delete') AS gone, arg_max(content, seq) FILTER (WHERE op = 'update') AS content FROM coded WHERE error IS NULL GROUP BY id)
SELECT c.id, coalesce(v, version)::INT AS version, CASE WHEN gone THEN 'deleted' WHEN v IS NOT NULL THEN 'active' ELSE status END AS status, coalesce(content, l2_content) AS l2_content FROM contexts c LEFT JOIN last USING (id)""")  # fmt: skip
def sequence_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cmd, results = _sequence(spark, sf_dir)
    return command_log.applied(rows, results, cmd).select("id", "version", "status", "l2_content")

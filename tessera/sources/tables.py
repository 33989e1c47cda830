"""Logical tables of governed contexts, projected from the Parquet tables of a data folder.

Each function takes (spark, sf_dir). Ids are derived from the whole input; no rows are left out. VIEWS is the same as DuckDB SQL: a
chain of common table expressions that the checks put before their queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
ACCOUNTS = ("acme", "beta")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def pick(key: Column, values) -> Column:
    """The value whose place is key modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def account_of(key: Column) -> Column:
    return F.when(key % 5 < 4, "acme").otherwise("beta")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    root = spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit("").alias("path"), F.lit(None).cast("long").alias("parent_id"))
    regions = region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lower("r_name").alias("path"), F.lit(0).cast("long").alias("parent_id"))
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey).select((F.col("n_nationkey") + 6).cast("long").alias("id"), F.lower(F.concat("r_name", F.lit("/"), "n_name")).alias("path"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"))
    return root.unionByName(regions).unionByName(nations)


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(F.concat(F.lit("agent-"), key).alias("agent_id"), (F.col("s_nationkey") + 6).cast("long").alias("team_id"), F.when(key % 7 == 0, "admin").otherwise("member").alias("role"), F.when(key % 3 == 0, "read_only").otherwise("read_write").alias("access"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    d = read(spark, sf_dir, "documents").withColumn("team_key", key % 31)
    owners = teams(spark, sf_dir).select(F.col("id").alias("team_key"), F.col("path").alias("team_path"))
    scope = F.when(key % 4 == 3, "datalake").when(key % 8 == 1, "agent").otherwise("team")
    agent = F.concat(F.lit("agent-"), key % 10)
    kind = pick(key, ("resource", "memory", "skill", "table_schema"))
    status = F.when(key % 20 == 0, "stale").when(key % 20 == 1, "archived").when(key % 20 == 2, "deleted").when(key % 20 == 3, "pending_review").otherwise("active")
    place = F.when(scope == "datalake", F.concat(F.lit("datalake/prod/t"), key)).when(scope == "agent", F.concat(F.lit("agent/"), agent, F.lit("/memories/m"), key))
    place = place.when(F.col("team_path") == "", F.concat(F.lit("team/docs/d"), key)).otherwise(F.concat(F.lit("team/"), "team_path", F.lit("/docs/d"), key))
    accessed = as_of() - F.make_dt_interval((key % 200).cast("int"))
    return d.join(owners, "team_key").select(
        key.alias("id"), account_of(key).alias("account_id"), F.concat(F.lit("ctx://"), place).alias("uri"), kind.alias("context_type"), scope.alias("scope"),
        F.when(scope == "agent", agent).when(scope == "team", F.col("team_path")).alias("owner_space"), status.alias("status"), (key % 3 + 1).cast("int").alias("version"),
        F.left("text", F.lit(80)).alias("l0_content"), F.left("text", F.lit(300)).alias("l1_content"), F.col("text").alias("l2_content"), F.array("lang", "source").alias("tags"),
        accessed.alias("last_accessed_at"), F.when(status == "stale", accessed).alias("stale_at"), F.when(status == "archived", accessed).alias("archived_at"),
    )


def tenant(df: DataFrame, account: str) -> DataFrame:
    """Rows of one account; every read of a tenant's table goes through here."""
    return df.filter(F.col("account_id") == account)


#: uri pattern, principal, effect, actions, field masks, priority. Principals are agents or team paths.
POLICIES = (
    (1, "ctx://datalake/prod/t3*", "agent-1", "deny", ["read"], None, 10),
    (2, "ctx://datalake/prod/*", "agent-1", "allow", ["read"], ["the", "of"], 5),
    (3, "ctx://agent/agent-3/memories/*", "agent-1", "allow", ["read", "write"], None, 7),
    (4, "ctx://team/*", "", "allow", ["read"], ["and"], 1),
    (5, "ctx://agent/agent-5/memories/m65", "agent-1", "allow", ["read"], ["in"], 3),
    (6, "ctx://team/docs/d31*", "agent-1", "deny", ["read"], None, 0),
    (7, "ctx://team/*/docs/d9", "agent-1", "deny", ["read"], None, 0),
    (8, "ctx://agent/agent-3/*", "agent-1", "allow", ["read"], ["le"], 9),
    (9, "ctx://datalake/prod/t1%7", "agent-1", "deny", ["read"], None, 0),
    (10, "ctx://datalake/prod/t11*", "", "deny", ["read"], None, 0),
    (11, "ctx://datalake/prod/t5*", "agent-2", "deny", ["read"], None, 99),
    (12, "ctx://datalake/prod/t7*", "agent-1", "deny", ["write"], None, 99),
    (13, "ctx://agent/*/memories/m33", "agent-1", "allow", ["read"], ["is", "to"], 12),
)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*POLICIES], "policy_id long, pattern string, principal string, effect string, actions array<string>, field_masks array<string>, priority int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("int")})


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"signup": "created", "click": "modified", "purchase": "version_published", "view": "marked_stale", "error": "deleted"}
    return events(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("context_id"), account_of(F.col("user_id")).alias("account_id"),
        F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")].alias("change_type"),
        (F.col("event_id") % 5 + 1).cast("int").alias("new_version"), (F.col("k") >= 50).alias("is_breaking"),
    )


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select(key.alias("dependent_id"), F.expr("doc_id div 3").alias("dependency_id"), pick(key, ("skill_version", "table_schema", "derived_from")).alias("dep_type"), F.nullif(key % 4, F.lit(0)).cast("int").alias("pinned_version"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((key % 30).cast("int"))).alias("created_at"))
    return d.filter("dependent_id <> dependency_id")


def skill_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish commands of skills, before versions are numbered."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    status = F.when(F.col("event_id") % 11 == 0, "draft").when(F.col("event_id") % 7 == 0, "deprecated").otherwise("published")
    return e.select(F.col("user_id").alias("skill_id"), "event_id", "ts", F.concat(F.lit("v "), F.col("event_id")).alias("content"), (F.col("k") >= 50).alias("is_breaking"), status.alias("status"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("agent-"), key % 10).alias("agent_id"), F.expr("c_custkey div 10").alias("skill_id"), F.nullif(key % 4, F.lit(0)).cast("int").alias("pinned_version"), account_of(key).alias("account_id"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type <> 'signup'")
    outcomes = {"purchase": "adopted", "click": "corrected", "view": "ignored", "error": "irrelevant"}
    return e.select("event_id", "ts", F.col("user_id").alias("context_id"), F.concat(F.lit("r"), F.col("event_id") % 50).alias("retrieval_id"), F.concat(F.lit("agent-"), F.col("event_id") % 10).alias("actor"), F.create_map(*[F.lit(x) for kv in outcomes.items() for x in kv])[F.col("event_type")].alias("outcome"))


#: Foreign keys between the tables of a data folder: (table, column, referenced table, referenced column).
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
)


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(upstream, downstream): foreign keys, a tree over all suppliers and one edge that closes a cycle."""
    fixed = spark.createDataFrame([(up, down) for down, _, up, _ in FOREIGN_KEYS] + [("lineitem", "nation")], "upstream string, downstream string")
    tree = read(spark, sf_dir, "supplier").filter("s_suppkey > 0").select(F.concat(F.lit("s"), F.expr("s_suppkey div 2")).alias("upstream"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("downstream"))
    return fixed.unionByName(tree).distinct()


# Thresholds in days (stale, archive, delete) of kinds and scopes that an account has no policy for.
LIFECYCLE_DEFAULTS = (("memory", "agent", 90, 30, 180), ("memory", "team", 0, 60, 0), ("resource", "datalake", 0, 0, 0), ("resource", "team", 0, 0, 0), ("skill", "team", 0, 90, 0))
#: An account's own policies.
LIFECYCLE_OWN = (("acme", "resource", "team", 30, 60, 120), ("acme", "memory", "team", 90, 90, 0), ("beta", "skill", "team", 150, 0, 0))
_LIFECYCLE = "account_id string, context_type string, scope string, stale_after_days int, archive_after_days int, delete_after_days int"


def lifecycle_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*LIFECYCLE_OWN], _LIFECYCLE)


def lifecycle_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a, *p) for a in ACCOUNTS for p in LIFECYCLE_DEFAULTS], _LIFECYCLE)


def _list(values) -> str:
    return "NULL::VARCHAR[]" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWS = f"""
WITH RECURSIVE teams AS (
  SELECT 0::BIGINT AS id, '' AS path, NULL::BIGINT AS parent_id
  UNION ALL SELECT r_regionkey + 1, lower(r_name), 0 FROM region
  UNION ALL SELECT n_nationkey + 6, lower(r_name || '/' || n_name), n_regionkey + 1 FROM nation JOIN region ON n_regionkey = r_regionkey
), memberships AS (
  SELECT 'agent-' || s_suppkey AS agent_id, (s_nationkey + 6)::BIGINT AS team_id, CASE WHEN s_suppkey % 7 = 0 THEN 'admin' ELSE 'member' END AS role,
    CASE WHEN s_suppkey % 3 = 0 THEN 'read_only' ELSE 'read_write' END AS access FROM supplier
), c0 AS (
  SELECT d.*, t.path, CASE WHEN doc_id % 4 = 3 THEN 'datalake' WHEN doc_id % 8 = 1 THEN 'agent' ELSE 'team' END AS scope,
    TIMESTAMP '{AS_OF}' - (doc_id % 200)::INT * INTERVAL 1 DAY AS last_accessed_at,
    CASE doc_id % 20 WHEN 0 THEN 'stale' WHEN 1 THEN 'archived' WHEN 2 THEN 'deleted' WHEN 3 THEN 'pending_review' ELSE 'active' END AS status
  FROM documents d JOIN teams t ON t.id = d.doc_id % 31
), contexts AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 5 < 4 THEN 'acme' ELSE 'beta' END AS account_id,
    'ctx://' || CASE WHEN scope = 'datalake' THEN 'datalake/prod/t' || doc_id WHEN scope = 'agent' THEN 'agent/agent-' || doc_id % 10 || '/memories/m' || doc_id
      WHEN path = '' THEN 'team/docs/d' || doc_id ELSE 'team/' || path || '/docs/d' || doc_id END AS uri,
    ['resource', 'memory', 'skill', 'table_schema'][doc_id % 4 + 1] AS context_type, scope,
    CASE scope WHEN 'agent' THEN 'agent-' || doc_id % 10 WHEN 'team' THEN path END AS owner_space, status, (doc_id % 3 + 1)::INT AS version,
    left(text, 80) AS l0_content, left(text, 300) AS l1_content, text AS l2_content, [lang, source] AS tags, last_accessed_at,
    CASE WHEN status = 'stale' THEN last_accessed_at END AS stale_at, CASE WHEN status = 'archived' THEN last_accessed_at END AS archived_at
  FROM c0
), policies(policy_id, pattern, principal, effect, actions, field_masks, priority) AS (
  VALUES {", ".join(f"({i}, '{p}', '{w}', '{e}', {_list(a)}, {_list(m)}, {n})" for i, p, w, e, a, m, n in POLICIES)}
), change_events AS (
  SELECT event_id, ts, user_id AS context_id, CASE WHEN user_id % 5 < 4 THEN 'acme' ELSE 'beta' END AS account_id,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'modified' WHEN 'purchase' THEN 'version_published' WHEN 'view' THEN 'marked_stale' WHEN 'error' THEN 'deleted' END AS change_type,
    (event_id % 5 + 1)::INT AS new_version, (props->>'$.k')::INT >= 50 AS is_breaking FROM events
), dependencies AS (
  SELECT doc_id AS dependent_id, doc_id // 3 AS dependency_id, ['skill_version', 'table_schema', 'derived_from'][doc_id % 3 + 1] AS dep_type, nullif(doc_id % 4, 0)::INT AS pinned_version,
    TIMESTAMP '2024-01-01' + (doc_id % 30)::INT * INTERVAL 1 DAY AS created_at FROM documents WHERE doc_id <> doc_id // 3
), skill_commands AS (
  SELECT user_id AS skill_id, event_id, ts, 'v ' || event_id AS content, (props->>'$.k')::INT >= 50 AS is_breaking,
    CASE WHEN event_id % 11 = 0 THEN 'draft' WHEN event_id % 7 = 0 THEN 'deprecated' ELSE 'published' END AS status FROM events WHERE event_type = 'purchase'
), skill_versions AS (
  SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY ts, event_id)::INT AS version FROM skill_commands
), subscriptions AS (
  SELECT 'agent-' || c_custkey % 10 AS agent_id, c_custkey // 10 AS skill_id, nullif(c_custkey % 4, 0)::INT AS pinned_version, CASE WHEN c_custkey % 5 < 4 THEN 'acme' ELSE 'beta' END AS account_id FROM customer
), feedback AS (
  SELECT event_id, ts, user_id AS context_id, 'r' || event_id % 50 AS retrieval_id, 'agent-' || event_id % 10 AS actor,
    CASE event_type WHEN 'purchase' THEN 'adopted' WHEN 'click' THEN 'corrected' WHEN 'view' THEN 'ignored' WHEN 'error' THEN 'irrelevant' END AS outcome FROM events WHERE event_type <> 'signup'
), lineage AS (
  SELECT DISTINCT upstream, downstream FROM (
    VALUES {", ".join(f"('{up}', '{down}')" for down, _, up, _ in FOREIGN_KEYS)}, ('lineitem', 'nation')
    UNION ALL SELECT 's' || s_suppkey // 2, 's' || s_suppkey FROM supplier WHERE s_suppkey > 0) AS x(upstream, downstream)
), lifecycle_own(account_id, context_type, scope, stale_after_days, archive_after_days, delete_after_days) AS (
  VALUES {", ".join(map(str, LIFECYCLE_OWN))}
), lifecycle_defaults(account_id, context_type, scope, stale_after_days, archive_after_days, delete_after_days) AS (
  VALUES {", ".join(str((a, *p)) for a in ACCOUNTS for p in LIFECYCLE_DEFAULTS)}
), lifecycle_policies AS (
  SELECT * FROM lifecycle_own UNION ALL SELECT * FROM lifecycle_defaults d WHERE NOT EXISTS (
    SELECT 1 FROM lifecycle_own o WHERE o.account_id = d.account_id AND o.context_type = d.context_type AND o.scope = d.scope)
), visible AS (
  SELECT m.agent_id, t.id, t.path, t.parent_id, true AS direct FROM memberships m JOIN teams t ON t.id = m.team_id
  UNION SELECT v.agent_id, t.id, t.path, t.parent_id, false FROM visible v JOIN teams t ON t.id = v.parent_id
)"""

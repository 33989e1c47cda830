"""Queries of feedback, lifecycle, skills, audit, propagation and streams (M05, M08-M15, M21, N, D13-D20)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, audit, counter_store, feedback, lifecycle, propagation, skills
from ..sources import tables
from ..sources.shared import shared_dir
from ..streaming import delivery, outbox
from . import common
from .common import COUNTERS, LATEST

QUERIES, ORACLES, query = common.book()
_NTZ = ("ts", "stale_at", "archived_at", "last_accessed_at", "next_retry_at", "claimed_at", "window_start", "session_start", "session_end")


def _plain_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c in _NTZ})


@query("M14_latest_feedback", f"{tables.VIEWS}, {LATEST} SELECT context_id, retrieval_id, actor, outcome, event_id FROM latest")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.latest(tables.feedback(spark, sf_dir)).select("context_id", "retrieval_id", "actor", "outcome", "event_id")


@query("D13_merged_counters", f"{tables.VIEWS}, {LATEST}, {COUNTERS} SELECT id, adopted, ignored, active FROM counters")
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback in three batches, out of order, merged into kept counters: those of a recount."""
    store, rows = counter_store.CounterStore(spark, f"{shared_dir(spark)}/counters-{uuid.uuid4().hex}"), tables.feedback(spark, sf_dir)
    for k in (2, 0, 1):
        store.apply(rows.filter(F.col("event_id") % 3 == k))
    return store.counters()


_QUALITY = """SELECT *, round(CASE WHEN adopted + ignored > 0 THEN adopted::DOUBLE / (adopted + ignored) END, 6) AS adoption_rate,
  round(CASE WHEN adopted + ignored >= 5 THEN 0.5 + 0.5 * adopted / (adopted + ignored + 1) ELSE 1.0 END, 6)::DOUBLE AS quality_score FROM counters"""


@query("D14_quality_scores", f"{tables.VIEWS}, {LATEST}, {COUNTERS} {_QUALITY}")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.quality_scores(common.counters(spark, sf_dir))


@query("M15_quality_report", f"""{tables.VIEWS}, {LATEST}, {COUNTERS} SELECT uri, active, adopted, ignored, round(adopted::DOUBLE / (adopted + ignored), 6) AS rate FROM counters JOIN contexts USING (id)
  WHERE status <> 'deleted' AND active > 10 AND adopted + ignored >= 5 AND round(adopted::DOUBLE / (adopted + ignored), 6) < 0.5""")  # fmt: skip
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.quality_report(common.counters(spark, sf_dir), tables.contexts(spark, sf_dir), max_rate=0.5)


@query("B14_feedback_page", f"{tables.VIEWS}, {LATEST} SELECT event_id, context_id, outcome FROM latest WHERE retrieval_id = 'r7' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 5")
def feedback_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.page(tables.feedback(spark, sf_dir), retrieval_id="r7", offset=5).select("event_id", "context_id", "outcome")


def _log(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("agent-"), F.col("user_id") % 10).alias("actor"), F.col("event_type").alias("action"), F.concat(F.lit("ctx://team/docs/d"), "user_id").alias("resource"), F.when(F.col("k") < 80, "success").otherwise("denied").alias("result"), "value")


_LOG = "log AS (SELECT event_id, ts, 'agent-' || user_id % 10 AS actor, event_type AS action, 'ctx://team/docs/d' || user_id AS resource, CASE WHEN (props->>'$.k')::INT < 80 THEN 'success' ELSE 'denied' END AS result, value FROM events)"


@query("M21_audit_page", f"WITH {_LOG} SELECT event_id, actor, action, resource FROM log WHERE actor = 'agent-3' AND result = 'denied' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 3")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.query(_log(spark, sf_dir), actor="agent-3", result="denied", since="2024-01-05", until="2024-01-25", offset=3).select("event_id", "actor", "action", "resource")


@query("D19_latencies", f"WITH {_LOG}, p AS (SELECT action, count(*) AS n, quantile_cont(value::DOUBLE, [0.5, 0.95, 0.99]) AS q FROM log GROUP BY action) SELECT action, n, round(q[1], 6) AS p50, round(q[2], 6) AS p95, round(q[3], 6) AS p99 FROM p")
def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latencies(_log(spark, sf_dir), "action", "value")


_PRICES = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE l_linenumber::VARCHAR END AS key, l_extendedprice::DOUBLE AS price FROM lineitem"


@query("D19_percentiles", f"WITH p AS ({_PRICES}), x AS (SELECT key, unnest([0.0, 0.5, 0.95, 0.99, 1.0]) AS q, unnest(quantile_cont(price, [0.0, 0.5, 0.95, 0.99, 1.0])) AS v FROM p GROUP BY key) SELECT key, q::DOUBLE AS q, round(v, 6) AS value FROM x")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of prices, a third of which have one key."""
    rows = tables.read(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.col("l_linenumber").cast("string")).alias("key"), F.col("l_extendedprice").alias("price"))
    return audit.percentiles(rows, "key", "price", [0.0, 0.5, 0.95, 0.99, 1.0]).withColumn("value", F.round("value", 6))


@query("D20_pass_rates", f"WITH {_LOG} SELECT action, count(*) AS checks, count(*) FILTER (WHERE result = 'success') AS passed, round(avg((result = 'success')::INT), 6) AS rate FROM log GROUP BY action")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pass_rates(_log(spark, sf_dir).withColumn("ok", F.col("result") == "success"), "action", "ok")


@query("X_audit_rollup", f"WITH {_LOG} SELECT actor, action, count(*) AS n FROM log GROUP BY ROLLUP (actor, action)")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).rollup("actor", "action").agg(F.count("*").alias("n"))


_SWEEP = f"""joined AS (SELECT c.*, p.stale_after_days AS a, p.archive_after_days AS b, p.delete_after_days AS d, TIMESTAMP '{tables.AS_OF}' AS now, EXISTS (SELECT 1 FROM change_events e WHERE e.account_id = c.account_id) AS swept
  FROM contexts c LEFT JOIN lifecycle_policies p USING (account_id, context_type, scope)),
swept AS (SELECT *, CASE WHEN swept AND status = 'active' AND a > 0 AND last_accessed_at < now - a * INTERVAL 1 DAY THEN 'stale' WHEN swept AND status = 'stale' AND b > 0 AND stale_at < now - b * INTERVAL 1 DAY THEN 'archived'
  WHEN swept AND status = 'archived' AND d > 0 AND archived_at < now - d * INTERVAL 1 DAY THEN 'deleted' ELSE status END AS new_status FROM joined)"""


@query("M12_sweep", f"""{tables.VIEWS}, {_SWEEP} SELECT id, status, new_status, CASE WHEN status = 'active' AND new_status = 'stale' THEN now ELSE stale_at END AS stale_at, CASE WHEN status = 'stale' AND new_status = 'archived' THEN now ELSE archived_at END AS archived_at FROM swept""")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = lifecycle.with_defaults(tables.lifecycle_policies(spark, sf_dir), tables.lifecycle_defaults(spark, sf_dir))
    out = lifecycle.sweep(tables.contexts(spark, sf_dir), policies, tables.change_events(spark, sf_dir), tables.as_of())
    return _plain_times(out.select("id", "status", "new_status", "stale_at", "archived_at"))


_KINDS = (("memory", "agent"), ("memory", "team"), ("resource", "datalake"), ("skill", "team"), ("resource", "agent"))
_ORDERS = f"""WITH orders_of AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 9 = 0 THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN c_custkey % 5 < 4 THEN 'acme' ELSE 'beta' END AS account_id,
  {[k for k, _ in _KINDS]}[c_nationkey % 5 + 1] AS context_type, {[s for _, s in _KINDS]}[c_nationkey % 5 + 1] AS scope, (c_custkey % 100)::INT AS stale_after_days, (c_custkey % 60)::INT AS archive_after_days, (c_custkey % 200)::INT AS delete_after_days FROM customer),
own AS (SELECT * EXCLUDE (seq, op) FROM orders_of QUALIFY row_number() OVER (PARTITION BY account_id, context_type, scope ORDER BY seq DESC) = 1 AND op <> 'delete'),
defaults(account_id, context_type, scope, stale_after_days, archive_after_days, delete_after_days) AS (VALUES {", ".join(str((a, *p)) for a in tables.ACCOUNTS for p in tables.LIFECYCLE_DEFAULTS)})
SELECT * FROM own UNION ALL SELECT * FROM defaults d WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.account_id = d.account_id AND o.context_type = d.context_type AND o.scope = d.scope)"""


@query("M13_policies", _ORDERS)
def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts and deletes of lifecycle policies, one a customer, and the defaults for what has none."""
    key, kind = F.col("c_custkey"), F.col("c_nationkey")
    days = [(key % n).cast("int").alias(c) for c, n in (("stale_after_days", 100), ("archive_after_days", 60), ("delete_after_days", 200))]
    cmd = tables.read(spark, sf_dir, "customer").select(key.alias("seq"), F.when(key % 9 == 0, "delete").otherwise("upsert").alias("op"), tables.account_of(key).alias("account_id"), tables.pick(kind, [k for k, _ in _KINDS]).alias("context_type"), tables.pick(kind, [s for _, s in _KINDS]).alias("scope"), *days)
    return lifecycle.with_defaults(access.upserted(cmd, ["account_id", "context_type", "scope"]), tables.lifecycle_defaults(spark, sf_dir))


@query("M11_transitions", f""", cmd AS (SELECT c_custkey AS id, ['active', 'stale', 'archived', 'deleted'][c_custkey % 4 + 1] AS target FROM customer),
j AS (SELECT c.*, target, CASE WHEN target IS NULL THEN 'none' WHEN status = target THEN 'no-op' WHEN status || '>' || target IN ('active>stale', 'stale>active', 'stale>archived', 'archived>active', 'archived>deleted') THEN 'done' ELSE 'rejected' END AS outcome FROM contexts c LEFT JOIN cmd USING (id))
SELECT id, CASE WHEN outcome = 'done' THEN target ELSE status END AS status, outcome, CASE WHEN outcome = 'done' AND status = 'stale' AND target = 'active' THEN TIMESTAMP '{tables.AS_OF}' ELSE last_accessed_at END AS last_accessed_at,
  CASE WHEN outcome = 'done' AND target = 'stale' THEN TIMESTAMP '{tables.AS_OF}' WHEN outcome = 'done' AND status = 'stale' AND target = 'active' THEN NULL ELSE stale_at END AS stale_at FROM j""")  # fmt: skip
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tables.pick(F.col("c_custkey"), ("active", "stale", "archived", "deleted")).alias("target"))
    return _plain_times(lifecycle.transition(tables.contexts(spark, sf_dir), cmd, tables.as_of()).select("id", "status", "outcome", "last_accessed_at", "stale_at"))


@query("M05_touched", """, seen AS (SELECT user_id AS id, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT c.id, CASE WHEN status = 'stale' AND last IS NOT NULL THEN 'active' ELSE status END AS status, coalesce(n, 0) AS n_reads, coalesce(last, last_accessed_at) AS last_accessed_at FROM contexts c LEFT JOIN seen USING (id)""")  # fmt: skip
def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = tables.events(spark, sf_dir).filter("event_type = 'view'").select(F.col("user_id").alias("context_id"), F.col("ts").alias("accessed_at"))
    return _plain_times(lifecycle.touched(tables.contexts(spark, sf_dir), reads).select("id", "status", "n_reads", "last_accessed_at"))


def _versions(spark, sf_dir):
    return skills.numbered(tables.skill_commands(spark, sf_dir))


@query("M08_numbered_versions", "SELECT skill_id, event_id, version, status FROM skill_versions")
def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("skill_id", "event_id", "version", "status")


@query("D02_heads", "SELECT skill_id, max(version) AS head, max(version) FILTER (WHERE status = 'published') AS published FROM skill_versions GROUP BY skill_id")
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.heads(_versions(spark, sf_dir))


@query("M09_versions", "SELECT version, status, is_breaking, content FROM skill_versions WHERE skill_id = 3 AND status IN ('published', 'deprecated')")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.listed(_versions(spark, sf_dir), 3)


@query("M09_subscriptions", """SELECT agent_id, s.skill_id, pinned_version, CASE WHEN pinned_version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM skill_versions v WHERE v.skill_id = s.skill_id AND v.version = pinned_version AND v.status = 'published') THEN 404 END::INT AS error FROM subscriptions s""")
def subscribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.subscribed(tables.subscriptions(spark, sf_dir), _versions(spark, sf_dir)).select("agent_id", "skill_id", "pinned_version", "error")


@query("M10_resolved", """, req AS (SELECT 'agent-' || c_custkey % 10 AS agent_id, c_custkey // 10 AS skill_id, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 9 + 1)::INT END AS wanted FROM customer),
pins AS (SELECT agent_id, skill_id, max(pinned_version) AS pin FROM subscriptions GROUP BY 1, 2), heads AS (SELECT skill_id, max(version) FILTER (WHERE status = 'published') AS published FROM skill_versions GROUP BY 1),
r AS (SELECT req.*, pin, published, coalesce(wanted, pin) AS chosen, c.version AS head, c.l2_content AS l2 FROM req LEFT JOIN pins USING (agent_id, skill_id) LEFT JOIN heads USING (skill_id) LEFT JOIN contexts c ON c.id = req.skill_id),
c AS (SELECT r.*, v.status, v.content, CASE WHEN chosen IS NULL THEN published IS NULL OR head IS NULL ELSE v.skill_id IS NULL END AS bad FROM r LEFT JOIN skill_versions v ON v.skill_id = r.skill_id AND v.version = r.chosen AND v.status IN ('published', 'deprecated'))
SELECT agent_id, skill_id, CASE WHEN NOT bad THEN coalesce(chosen, head) END AS version, CASE WHEN NOT bad THEN CASE WHEN chosen IS NULL THEN l2 ELSE content END END AS content,
  CASE WHEN NOT bad THEN CASE WHEN wanted IS NULL AND pin IS NOT NULL AND published > chosen THEN 'v' || published || ' available, currently pinned to v' || chosen WHEN status = 'deprecated' THEN 'v' || chosen || ' is deprecated' END END AS advisory, CASE WHEN bad THEN 404 END::INT AS error FROM c""")  # fmt: skip
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    req = tables.read(spark, sf_dir, "customer").select(F.concat(F.lit("agent-"), key % 10).alias("agent_id"), F.expr("c_custkey div 10").alias("skill_id"), F.when(key % 5 == 0, key % 9 + 1).cast("int").alias("wanted"))
    return skills.resolved(req, _versions(spark, sf_dir), tables.subscriptions(spark, sf_dir), tables.contexts(spark, sf_dir))


@query("C06_dependents_as_of", "SELECT event_id, dependent_id, dep_type FROM change_events JOIN dependencies ON dependency_id = context_id AND created_at <= ts")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    return graph.dependents_as_of(tables.change_events(spark, sf_dir), tables.dependencies(spark, sf_dir)).select("event_id", "dependent_id", "dep_type")


_ACTIONS = """live AS (SELECT * FROM change_events WHERE change_type NOT IN ('marked_stale', 'deleted')),
acted AS (SELECT event_id, 'context' AS target_kind, dependent_id::VARCHAR AS target, CASE dep_type
    WHEN 'skill_version' THEN CASE WHEN change_type <> 'version_published' OR pinned_version IS NULL OR pinned_version >= new_version THEN 'no_action' WHEN is_breaking THEN 'mark_stale' ELSE 'notify' END
    WHEN 'table_schema' THEN 'auto_update' ELSE CASE WHEN change_type = 'modified' THEN 'notify' ELSE 'no_action' END END AS action
  FROM live JOIN dependencies ON dependency_id = context_id AND created_at <= ts
  UNION ALL SELECT event_id, 'agent', agent_id, CASE WHEN pinned_version IS NULL THEN 'notify' ELSE 'advisory' END FROM live JOIN subscriptions ON skill_id = context_id WHERE change_type = 'version_published')"""


@query("N05_actions", f"{tables.VIEWS}, {_ACTIONS} SELECT * FROM acted")
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagation.actions(tables.change_events(spark, sf_dir), tables.dependencies(spark, sf_dir), tables.subscriptions(spark, sf_dir))


@query("N11_effects", f"{tables.VIEWS}, {_ACTIONS} SELECT target::BIGINT AS id, bool_or(action = 'mark_stale') AS stale, bool_or(action = 'auto_update') AS update FROM acted WHERE target_kind = 'context' AND action IN ('mark_stale', 'auto_update') GROUP BY 1")
def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagation.effects(actions(spark, sf_dir))


@query("N06_regenerated", """SELECT dependent_id AS id, dependency_id, CASE WHEN o.l2_content IS NULL OR s.l2_content IS NULL THEN 'stale' ELSE 'updated' END AS outcome, left(o.l2_content || chr(10) || chr(10) || '[auto-update]' || chr(10) || s.l2_content, 300) AS l1_content
  FROM dependencies d JOIN contexts o ON o.id = dependent_id LEFT JOIN contexts s ON s.id = dependency_id WHERE dep_type = 'table_schema'""")  # fmt: skip
def regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.dependencies(spark, sf_dir).filter("dep_type = 'table_schema'").withColumnRenamed("dependent_id", "id")
    return propagation.regenerated(tables.contexts(spark, sf_dir), edges).select("id", "dependency_id", "outcome", "l1_content")


def _deliveries(spark, sf_dir):
    k = F.col("event_id")
    e = tables.events(spark, sf_dir)
    status = tables.pick(k, ("pending", "processing", "retry", "processed"))
    return e.select("event_id", "ts", status.alias("delivery_status"), (k % 80).cast("int").alias("attempt_count"), F.when(k % 3 > 0, F.col("ts") + F.make_dt_interval((k % 9).cast("int"))).alias("next_retry_at"), (tables.as_of() - F.make_dt_interval(mins=(k % 11).cast("int"))).alias("claimed_at"))


_DELIVERIES = f"""deliveries AS (SELECT event_id, ts, ['pending', 'processing', 'retry', 'processed'][event_id % 4 + 1] AS delivery_status, (event_id % 80)::INT AS attempt_count,
  CASE WHEN event_id % 3 > 0 THEN ts + (event_id % 9)::INT * INTERVAL 1 DAY END AS next_retry_at, TIMESTAMP '{tables.AS_OF}' - (event_id % 11)::INT * INTERVAL 1 MINUTE AS claimed_at FROM events)"""


@query("N02_claimed", f"""WITH {_DELIVERIES} SELECT event_id, delivery_status FROM deliveries WHERE (delivery_status IN ('pending', 'retry') AND coalesce(next_retry_at <= TIMESTAMP '{tables.AS_OF}', true))
  OR (delivery_status = 'processing' AND claimed_at < TIMESTAMP '{tables.AS_OF}' - INTERVAL 300 SECOND) ORDER BY ts, event_id LIMIT 100""")  # fmt: skip
def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagation.claimable(_deliveries(spark, sf_dir), tables.as_of()).select("event_id", "delivery_status")


@query("N07_finished", f"""WITH {_DELIVERIES} SELECT d.event_id, CASE WHEN event_id % 5 > 0 THEN 'processed' ELSE 'retry' END AS delivery_status, attempt_count + 1 AS attempt_count,
  CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '{tables.AS_OF}' + least(300, 5 * (attempt_count + 1)) * INTERVAL 1 SECOND END AS next_retry_at FROM deliveries d WHERE delivery_status = 'processing'""")  # fmt: skip
def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _deliveries(spark, sf_dir).filter("delivery_status = 'processing'")
    results = tables.events(spark, sf_dir).select("event_id", (F.col("event_id") % 5 > 0).alias("ok"))
    return _plain_times(propagation.finished(taken, results, tables.as_of()).select("event_id", "delivery_status", "attempt_count", "next_retry_at"))


@query("N09_stream_actions", f"{tables.VIEWS}, {_ACTIONS} SELECT * FROM acted")
def stream_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox written, read as a stream and propagated by micro-batch: the same rows as the batch operator."""
    base = f"{shared_dir(spark)}/outbox-{uuid.uuid4().hex}"
    outbox.append(tables.change_events(spark, sf_dir), f"{base}/events")
    stream = outbox.read_outbox(spark, f"{base}/events")
    outbox.propagate(stream, tables.dependencies(spark, sf_dir), tables.subscriptions(spark, sf_dir), f"{base}/actions", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/actions").drop("batch")


#: What workers say of each event: claims, results (some after the lease of 300 seconds, some none), claims of what is not due yet.
_SAID = (
    ("event_id >= 0", "0", "created"), ("event_id % 13 > 0", "10 + event_id % 7 * 60", "claimed"), ("event_id % 5 = 0", "20 + event_id % 7 * 60", "failed"), ("event_id % 5 > 1", "30 + event_id % 7 * 60 + CASE WHEN event_id % 11 = 0 THEN 300 ELSE 0 END", "done"),
    ("event_id % 3 = 0", "22 + event_id % 7 * 60", "claimed"), ("event_id % 4 = 0", "400 + event_id % 7 * 60", "claimed"), ("event_id % 8 = 0", "410 + event_id % 7 * 60", "done"), ("event_id % 12 = 0", "409 + event_id % 7 * 60", "failed"),
)
_MESSAGES = " UNION ALL ".join(f"SELECT event_id, ts + to_seconds({at}) AS ts, '{kind}' AS kind FROM events WHERE {which}" for which, at, kind in _SAID)
_STATES = f"""{tables.VIEWS}, said AS ({_MESSAGES}), m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, kind) AS k FROM said), most AS (SELECT max(ts) AS now FROM said),
walk AS (SELECT event_id, 0::BIGINT AS k, NULL::VARCHAR AS status, 0 AS attempts, NULL::TIMESTAMP AS claimed, NULL::TIMESTAMP AS due FROM (SELECT DISTINCT event_id FROM m)
  UNION ALL SELECT event_id, k, CASE WHEN kind = 'created' AND status IS NULL THEN 'pending' WHEN takes THEN 'processing' WHEN kind = 'done' AND status = 'processing' THEN 'processed' WHEN kind = 'failed' AND status = 'processing' THEN 'retry' ELSE status END,
    attempts + takes::INT, CASE WHEN takes THEN ts WHEN kind IN ('done', 'failed') AND status = 'processing' THEN NULL ELSE claimed END,
    CASE WHEN takes OR (kind = 'done' AND status = 'processing') THEN NULL WHEN kind = 'failed' AND status = 'processing' THEN ts + to_seconds(least(300, 5 * attempts)) ELSE due END
  FROM (SELECT *, kind = 'claimed' AND coalesce(status = 'pending' OR (status = 'retry' AND due <= ts), false) AS takes FROM (
    SELECT m.event_id, m.k, m.ts, m.kind, w.attempts, CASE WHEN late THEN 'retry' ELSE w.status END AS status, CASE WHEN NOT late THEN w.claimed END AS claimed, CASE WHEN late THEN w.claimed + to_seconds(300) ELSE w.due END AS due
    FROM (SELECT walk.*, m.ts AS at, coalesce(walk.status = 'processing' AND walk.claimed + to_seconds(300) < m.ts, false) AS late FROM walk JOIN m ON m.event_id = walk.event_id AND m.k = walk.k + 1) w JOIN m ON m.event_id = w.event_id AND m.k = w.k + 1))),
ends AS (SELECT event_id, unnest(max_by(struct_pack(status, attempts, claimed, due), k)) FROM walk GROUP BY event_id)
SELECT event_id, CASE WHEN late THEN 'retry' ELSE status END AS delivery_status, attempts::INT AS attempt_count, CASE WHEN NOT late THEN claimed END AS claimed_at, CASE WHEN late THEN claimed + to_seconds(300) ELSE due END AS next_retry_at
FROM (SELECT *, coalesce(status = 'processing' AND claimed + to_seconds(300) < now + to_seconds(86400), false) AS late FROM ends, most)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.events(spark, sf_dir)
    said = [rows.filter(which).select("event_id", (F.col("ts") + F.make_dt_interval(secs=F.expr(at))).alias("ts"), F.lit(kind).alias("kind")) for which, at, kind in _SAID]
    return reduce(DataFrame.unionByName, said)


def _now(messages: DataFrame):
    """A day after the last message."""
    return messages.agg((F.max("ts") + F.make_dt_interval(days=F.lit(1))).alias("now")).first()["now"]


@query("N07_delivery_states", _STATES)
def delivery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    return _plain_times(delivery.states(messages, F.lit(_now(messages))))


@query("N08_stream_states", _STATES)
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as a stream with timers: a tick moves time on, and leases that nobody ended run out."""
    messages, base = _messages(spark, sf_dir), f"{shared_dir(spark)}/delivery-{uuid.uuid4().hex}"
    tick = spark.createDataFrame([(-1, _now(messages), "tick")], delivery.MESSAGE)
    messages.unionByName(tick).write.parquet(f"{base}/messages")
    stream = spark.readStream.schema(delivery.MESSAGE).parquet(f"{base}/messages")
    delivery.follow(stream, f"{base}/states", f"{base}/checkpoint").awaitTermination()
    return _plain_times(delivery.latest(spark.read.parquet(f"{base}/states")))


@query("X_tumbling_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, change_type, count(*) AS n FROM change_events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(outbox.tumbling_counts(tables.change_events(spark, sf_dir)))


@query("X_sessions", """, g AS (SELECT context_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM change_events WINDOW w AS (PARTITION BY context_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY context_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT context_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY context_id, no""")  # fmt: skip
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(outbox.sessions(tables.change_events(spark, sf_dir)))

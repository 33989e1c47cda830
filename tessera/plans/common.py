"""What the modules of queries share: the request's parameters, projected inputs, and SQL that several checks begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import feedback, graph
from ..sources import tables

ACCOUNT, AGENT, TOP_K = "acme", "agent-1", 20
QUERY = "the and that of the le"


def book() -> tuple[dict, dict, Callable]:
    """Empty dictionaries of queries and checks, and the decorator that fills them."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = f
            if sql:
                oracles[name] = sql if sql.lstrip().upper().startswith("WITH") else f"{tables.VIEWS}\n{sql}"
            return f

        return keep

    return queries, oracles, query


def contexts(spark: SparkSession, sf_dir: str, account: str = ACCOUNT) -> DataFrame:
    return tables.tenant(tables.contexts(spark, sf_dir), account)


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible_teams(tables.memberships(spark, sf_dir), tables.teams(spark, sf_dir))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.counters(tables.feedback(spark, sf_dir))


#: Common table expressions after VIEWS.
MINE = f"mine AS (SELECT path, bool_or(direct) AS direct FROM visible WHERE agent_id = '{AGENT}' GROUP BY path)"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context_id, retrieval_id, actor ORDER BY ts DESC, event_id DESC) AS rn FROM feedback) WHERE rn = 1)"
COUNTERS = """counters AS (SELECT context_id AS id, count(*) FILTER (WHERE outcome IN ('adopted', 'corrected')) AS adopted,
  count(*) FILTER (WHERE outcome IN ('ignored', 'irrelevant')) AS ignored, count(*) AS active FROM latest GROUP BY context_id)"""
_BASE = f"""CASE scope WHEN 'datalake' THEN true WHEN 'agent' THEN owner_space = '{AGENT}' WHEN 'team' THEN owner_space IN (SELECT path FROM mine) ELSE false END"""


def decided(source: str) -> str:
    """`decided`: rows of a table expression with reason and field_masks for AGENT."""
    return f"""principals AS (SELECT path AS principal, NOT direct AS above FROM mine UNION ALL SELECT '{AGENT}', false),
pol AS (SELECT p.*, above FROM policies p JOIN principals USING (principal) WHERE list_contains(actions, 'read')),
hits AS (SELECT c.uri, bool_or(effect = 'deny' AND above) AS a, bool_or(effect = 'deny') AS d, max(struct_pack(p := priority, i := -policy_id, m := field_masks)) FILTER (WHERE effect = 'allow') AS w
  FROM (SELECT DISTINCT uri FROM {source}) c JOIN pol ON CASE WHEN ends_with(pattern, '*') THEN starts_with(uri, left(pattern, -1)) ELSE uri = pattern END GROUP BY c.uri),
decided AS (SELECT * EXCLUDE (a, d, w), CASE WHEN reason = 'explicit allow' THEN w.m END AS field_masks FROM (
  SELECT c.*, h.a, h.d, h.w, CASE WHEN h.a THEN 'parent team deny' WHEN h.d THEN 'explicit deny' WHEN h.w IS NOT NULL THEN 'explicit allow' WHEN coalesce({_BASE}, false) THEN 'baseline' ELSE 'no access' END AS reason
  FROM {source} c LEFT JOIN hits h ON h.uri = c.uri WHERE c.status <> 'deleted'))"""


def masked(column: str) -> str:
    return f"CASE WHEN field_masks IS NULL THEN {column} ELSE list_reduce([{column}] || field_masks, lambda a, k: regexp_replace(a, k, '[MASKED]', 'gi')) END"

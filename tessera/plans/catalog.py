"""Queries of catalogs, lineage and SQL context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as ops
from ..operators import graph, lineage_labels, snapshots
from ..operators import retrieval as search
from ..sources import tables
from ..sources.catalog import TABLES, ParquetCatalog
from ..sources.shared import new_folder
from . import common
from . import retrieval as searches
from .common import AGENT, MINE

QUERIES, ORACLES, query = common.book()
_NAMES = ", ".join(f"'{t}'" for t in TABLES)


@query("A04_table_columns", f"WITH c AS (SELECT DISTINCT table_name, column_name, column_index FROM duckdb_columns() WHERE table_name IN ({_NAMES})) SELECT table_name, string_agg(column_name, ',' ORDER BY column_index) AS names FROM c GROUP BY table_name")
def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ParquetCatalog(spark, sf_dir).snapshot().select("table_name", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"))


@query("A04_table_rows", "WITH " + "x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ParquetCatalog(spark, sf_dir)
    return reduce(DataFrame.unionByName, [c.frame(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in c.tables()])


@query("A04_samples")
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ParquetCatalog(spark, sf_dir)
    return reduce(DataFrame.unionByName, [c.sample(t).select(F.lit(t).alias("table_name"), "row") for t in c.tables()])


@query("H08_rendered_tables", f"""WITH c AS (SELECT DISTINCT table_name, column_name FROM duckdb_columns() WHERE table_name IN ({_NAMES})),
n AS (SELECT table_name, list(column_name) AS names FROM c GROUP BY table_name)
SELECT table_name, left(table_name || ' {ops.TABLE_WORD} - ' || CASE {" ".join(f"WHEN list_has_all(names, {list(w)}) THEN '{label}'" for w, label in ops.RULES)} ELSE table_name || ' 数据表' END, 80) AS l0_content FROM n""")  # fmt: skip
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rendered(ParquetCatalog(spark, sf_dir).snapshot()).select("table_name", "l0_content")


_OLD = "SELECT DISTINCT 't' || user_id AS table_name, 'ddl ' || user_id % 3 AS ddl, (user_id % 4 + 2)::INT AS version FROM events"
_NEW = "SELECT DISTINCT 't' || (user_id + 5) AS table_name, 'ddl ' || (user_id + 5) % 2 AS ddl FROM events"


def _synced(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    old = e.select(F.concat(F.lit("t"), "u").alias("table_name"), F.concat(F.lit("ddl "), F.col("u") % 3).alias("ddl"), (F.col("u") % 4 + 2).cast("int").alias("version"))
    new = e.select(F.concat(F.lit("t"), F.col("u") + 5).alias("table_name"), F.concat(F.lit("ddl "), (F.col("u") + 5) % 2).alias("ddl"))
    return ops.synced(old, new)


_ACTIONS = f"""old AS ({_OLD}), new AS ({_NEW}), acted AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, o.version AS was,
  CASE WHEN o.table_name IS NULL THEN 'created' WHEN n.table_name IS NULL THEN 'deleted' WHEN o.ddl <> n.ddl THEN 'changed' ELSE 'unchanged' END AS action FROM old o FULL JOIN new n ON o.table_name = n.table_name)"""


@query("M16_synced", f"WITH {_ACTIONS} SELECT table_name, action, CASE action WHEN 'created' THEN 2 WHEN 'changed' THEN was + 1 ELSE was END::INT AS version, action <> 'unchanged' AS has_event FROM acted")
def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir)


@query("D17_sync_counts", f"WITH {_ACTIONS} SELECT action, count(*) AS n FROM acted GROUP BY action")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sync_counts(_synced(spark, sf_dir))


@query("M18_stale_dependents", f"{tables.VIEWS}, {_ACTIONS} SELECT DISTINCT dependent_id FROM dependencies JOIN acted ON table_name = 't' || dependency_id WHERE dep_type = 'table_schema' AND action = 'deleted'")
def stale_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.dependencies(spark, sf_dir).withColumn("table_name", F.concat(F.lit("t"), "dependency_id"))
    return ops.stale_dependents(_synced(spark, sf_dir), edges)


_KEYS = f"keys(t, c, r, rc) AS (VALUES {', '.join(map(str, tables.FOREIGN_KEYS))}, ('ghost', 'x', 'orders', 'o_orderkey')), ok AS (SELECT * FROM keys WHERE t IN ({_NAMES}) AND r IN ({_NAMES}))"
_JOINS = "joins AS (SELECT least(t, r) AS table_a, greatest(t, r) AS table_b, string_agg(DISTINCT t || '.' || c || '=' || r || '.' || rc, ';' ORDER BY t || '.' || c || '=' || r || '.' || rc) AS join_columns FROM ok GROUP BY 1, 2)"


def _relationships(spark, sf_dir):
    keys = spark.createDataFrame([*tables.FOREIGN_KEYS, ("ghost", "x", "orders", "o_orderkey")], "table string, column string, referenced string, referenced_column string")
    return ops.relationships(keys, ParquetCatalog(spark, sf_dir).snapshot())


@query("M19_relationships", f"WITH {_KEYS}, {_JOINS} SELECT * FROM joins")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relationships(spark, sf_dir)[0]


@query("M19_lineage", f"WITH {_KEYS} SELECT DISTINCT r AS upstream, t AS downstream, 'fk' AS transform_type FROM ok")
def fk_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relationships(spark, sf_dir)[1]


@query("C05_neighbours", f"""WITH {_KEYS}, {_JOINS}, ends AS (SELECT table_a AS table_name, table_b AS other, join_columns FROM joins UNION ALL SELECT table_b, table_a, join_columns FROM joins)
SELECT table_name, '[' || string_agg('{{"other":"' || other || '","join_columns":"' || join_columns || '"}}', ',' ORDER BY other, join_columns) || ']' AS joins FROM ends GROUP BY table_name""")  # fmt: skip
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.neighbours(_relationships(spark, sf_dir)[0])


@query("D04_top_templates", """WITH t AS (SELECT user_id AS context_id, event_id AS id, (props->>'$.k')::INT AS n FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY n DESC, id) AS rn FROM t) SELECT context_id, string_agg(id::VARCHAR, ',' ORDER BY rn) AS templates FROM r WHERE rn <= 5 GROUP BY context_id""")  # fmt: skip
def top_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_templates(tables.events(spark, sf_dir).select(F.col("user_id").alias("context_id"), F.col("event_id").alias("id"), F.col("k").alias("hit_count")))


def _walk(start: str, a: str, b: str) -> str:
    return f""", walk AS (SELECT '{start}' AS node, 0 AS depth, ['{start}'] AS path UNION ALL SELECT {b}, depth + 1, list_append(path, {b}) FROM walk JOIN lineage ON {a} = node WHERE NOT list_contains(path, {b}))
SELECT node, min(depth)::INT AS depth FROM walk WHERE depth > 0 GROUP BY node"""


@query("C03_lineage_downstream", _walk("region", "upstream", "downstream"))
def downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(tables.lineage(spark, sf_dir), "region")


@query("C03_lineage_upstream", _walk("lineitem", "downstream", "upstream"))
def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(tables.lineage(spark, sf_dir), "lineitem", downstream=False)


@query("C03_lineage_tree", _walk("s0", "upstream", "downstream"))
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(tables.lineage(spark, sf_dir), "s0")


#: A later state of the parts: some are gone, some cost more, some are new.
_LATER = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 700 = 1 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part WHERE p_partkey % 500 <> 3 UNION ALL SELECT p_partkey + 1000000000, p_name, p_retailprice FROM part WHERE p_partkey % 900 = 5"


@query("M17_changes", f"""WITH old AS (SELECT p_partkey, p_name, p_retailprice AS price FROM part), new AS ({_LATER}) SELECT p_partkey, CASE WHEN o.p_name IS NULL THEN 'created' WHEN n.p_name IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM old o FULL JOIN new n USING (p_partkey) WHERE o.price IS DISTINCT FROM n.price OR o.p_name IS DISTINCT FROM n.p_name""")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created, changed and deleted rows between two snapshots, by their trees of hashes."""
    part, paths = tables.read(spark, sf_dir, "part"), [new_folder(spark, "snapshot") for _ in range(2)]
    snapshots.write(part.select("p_partkey", "p_name", F.col("p_retailprice").alias("price")), "p_partkey", paths[0], levels=1)
    snapshots.write(spark.sql(_LATER.replace("FROM part", "FROM {part}"), part=part), "p_partkey", paths[1], levels=1)
    return snapshots.changes(spark, *paths, "p_partkey")


_PAIRS = """, walk AS (SELECT upstream AS start, downstream AS node, 1 AS depth, [upstream, downstream] AS path FROM lineage
  UNION ALL SELECT start, downstream, depth + 1, list_append(path, downstream) FROM walk JOIN lineage ON upstream = node WHERE NOT list_contains(path, downstream)),
pairs AS (SELECT start, node, min(depth)::INT AS depth FROM walk WHERE start <> node GROUP BY start, node)"""
#: Of the nodes that are suppliers, one in seven is archived.
_ARCHIVED = "s_suppkey % 7 = 0"


@query("C03_lineage_pairs", f"{_PAIRS} SELECT * FROM pairs")
def lineage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is downstream of anything, with its depth."""
    return lineage_labels.build(tables.lineage(spark, sf_dir)).pairs()


@query("M20_lineage", f"""{_PAIRS}, hidden AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE {_ARCHIVED})
SELECT 'downstream' AS side, node, depth FROM pairs WHERE start = 's1' AND node NOT IN (FROM hidden) UNION ALL SELECT 'upstream', start, depth FROM pairs WHERE node = 's41' AND start NOT IN (FROM hidden)""")
def lineage_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lineage_labels.build(tables.lineage(spark, sf_dir))
    nodes = tables.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.when(F.expr(_ARCHIVED), "archived").otherwise("active").alias("status"))
    sides = [graph.lineage_of(labels, nodes, start, side == "downstream").select(F.lit(side).alias("side"), "node", "depth") for side, start in (("downstream", "s1"), ("upstream", "s41"))]
    return sides[0].unionByName(sides[1])


@query("C08_dependencies", """SELECT a.uri AS dependent_uri, b.uri AS dependency_uri, dep_type, pinned_version FROM dependencies JOIN contexts a ON a.id = dependent_id JOIN contexts b ON b.id = dependency_id WHERE dependent_id = 7 OR dependency_id = 7""")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies_of(tables.dependencies(spark, sf_dir), tables.contexts(spark, sf_dir), 7)


@query("M20_tables", f"""{tables.VIEWS}, {MINE}, tenant AS (SELECT * FROM contexts WHERE account_id = '{common.ACCOUNT}'), {common.decided("tenant")}
SELECT regexp_extract(uri, '[^/]*$') AS table_name, uri, status FROM decided WHERE scope = 'datalake' AND context_type = 'table_schema' AND status <> 'archived' AND reason IN ('explicit allow', 'baseline')""")  # fmt: skip
def table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = search.access.agent_teams(common.visible(spark, sf_dir), AGENT)
    return ops.table_list(common.contexts(spark, sf_dir), tables.policies(spark, sf_dir), teams, AGENT)


_META = "meta AS (SELECT 't' || doc_id AS table_name, 'CREATE TABLE t' || doc_id || ' (the_id bigint, ' || lang || ' string)' AS ddl FROM documents WHERE doc_id % 8 <> 3)"
_PAIRS = """pairs AS (SELECT 't' || doc_id AS table_a, 't' || doc_id + 4 AS table_b, 'k' || doc_id AS join_columns FROM documents WHERE doc_id % 4 = 3), ends AS (SELECT table_a AS table_name, table_b AS other, join_columns FROM pairs UNION ALL SELECT table_b, table_a, join_columns FROM pairs),
near AS (SELECT table_name, '[' || string_agg('{"other":"' || other || '","join_columns":"' || join_columns || '"}', ',' ORDER BY other, join_columns) || ']' AS joins FROM ends GROUP BY table_name)"""
_TEMPLATES = "used AS (SELECT table_name, string_agg(id::VARCHAR, ',' ORDER BY rn) AS templates FROM (SELECT 't' || user_id AS table_name, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY (props->>'$.k')::INT DESC, event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY table_name)"
_DDL = common.masked("ddl")


def _described(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    d, key = tables.read(spark, sf_dir, "documents"), F.col("doc_id")
    name = lambda n: F.concat(F.lit("t"), n)
    metadata = d.filter(key % 8 != 3).select(name(key).alias("table_name"), F.concat(F.lit("CREATE TABLE t"), key, F.lit(" (the_id bigint, "), "lang", F.lit(" string)")).alias("ddl"))
    joins = ops.neighbours(d.filter(key % 4 == 3).select(name(key).alias("table_a"), name(key + 4).alias("table_b"), F.concat(F.lit("k"), key).alias("join_columns")))
    used = ops.top_templates(tables.events(spark, sf_dir).select(F.col("user_id").alias("context_id"), F.col("event_id").alias("id"), F.col("k").alias("hit_count")))
    return {"metadata": metadata, "joins": joins, "templates": used.select(name(F.col("context_id")).alias("table_name"), "templates")}


@query("M20_details", f"""{tables.VIEWS}, {MINE}, tenant AS (SELECT * FROM contexts WHERE account_id = '{common.ACCOUNT}'), {common.decided("tenant")}, {_META}, {_PAIRS}, {_TEMPLATES}
SELECT table_name, {_DDL} AS ddl, joins, templates FROM (SELECT *, regexp_extract(uri, '[^/]*$') AS table_name FROM decided WHERE scope = 'datalake' AND context_type = 'table_schema' AND status <> 'archived' AND reason IN ('explicit allow', 'baseline'))
JOIN meta USING (table_name) LEFT JOIN near USING (table_name) LEFT JOIN used USING (table_name)""")  # fmt: skip
def table_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = search.access.agent_teams(common.visible(spark, sf_dir), AGENT)
    return ops.table_detail(common.contexts(spark, sf_dir), tables.policies(spark, sf_dir), teams, AGENT, **_described(spark, sf_dir)).select("table_name", "ddl", "joins", "templates")


_LAKE = searches.FOUND.replace("AND status NOT IN", "AND scope = 'datalake' AND context_type = 'table_schema' AND status NOT IN").replace(f"LIMIT {searches.POOL}", "LIMIT 75").replace(f"LIMIT {common.TOP_K}", "LIMIT 25")


@query("I16_sql_context", f"""{_LAKE}, {_META}, {_PAIRS}, {_TEMPLATES}, top AS (SELECT *, regexp_extract(uri, '[^/]*$') AS table_name FROM result WHERE starts_with(uri, 'ctx://datalake/prod/') ORDER BY place LIMIT 5)
SELECT place, id, uri, final_score, {common.masked("l0_content")} AS l0_content, {_DDL} AS ddl, joins, templates FROM top LEFT JOIN meta USING (table_name) LEFT JOIN near USING (table_name) LEFT JOIN used USING (table_name)""")  # fmt: skip
def sql_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = search.access.agent_teams(common.visible(spark, sf_dir), AGENT)
    found = ops.sql_context(common.contexts(spark, sf_dir), common.QUERY, tables.policies(spark, sf_dir), teams, common.counters(spark, sf_dir), AGENT, "prod", **_described(spark, sf_dir))
    return found.select("place", "id", "uri", "final_score", "l0_content", "ddl", "joins", "templates")

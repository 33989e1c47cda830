"""Sync of table catalogs: snapshots compared, rendered contents, relationships, SQL context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import access, retrieval

# Descriptions inferred from the columns that a table has, the first rule that fits.
RULES = ((("order_id", "product_id"), "订单明细"), (("order_id", "amount"), "支付记录"), (("user_id", "total_amount"), "订单数据"), (("email",), "用户信息"), (("price",), "商品信息"))
#: Groups over which the templates of one context are dealt.
SALTS = 64
TABLE_WORD, HEADER = "表", ("| 字段 | 类型 | 说明 |", "|---|---|---|")


def description(table: Column, names: Column) -> Column:
    """H09."""
    out = F.concat(table, F.lit(" 数据表"))
    for wanted, label in reversed(RULES):
        out = F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), names)) == 0, label).otherwise(out)
    return out


def rendered(snapshot: DataFrame) -> DataFrame:
    """A snapshot (database, table_name, columns) with ddl, l0 (80 characters at most) and l1 (500 at most)."""
    about = description(F.col("table_name"), F.transform("columns", lambda c: c["name"]))
    rows = F.transform("columns", lambda c: F.concat(F.lit("| "), c["name"], F.lit(" | "), c["type"], F.lit(" |  |")))
    head = F.concat(F.array(F.concat(F.lit("## "), "database", F.lit("."), "table_name"), F.lit(""), F.col("about"), F.lit(""), *[F.lit(h) for h in HEADER]), rows)
    ddl = F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" ("), F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["type"])), ", "), F.lit(")"))
    with_about = snapshot.withColumn("about", about)
    l0 = F.left(F.concat("table_name", F.lit(f" {TABLE_WORD} - "), "about"), F.lit(80))
    return with_about.select("database", "table_name", ddl.alias("ddl"), l0.alias("l0_content"), F.left(F.array_join(head, "\n"), F.lit(500)).alias("l1_content"))


def synced(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_name, ddl, version) before and (table_name, ddl) now -> action, version, has_event of each table.

    created (version 2: one for the row, one for its event), changed (version + 1), unchanged, deleted (archived, with an event).
    """
    both = old.select("table_name", F.col("ddl").alias("was"), "version").join(new.select("table_name", "ddl"), "table_name", "full")
    action = F.when(F.col("was").isNull(), "created").when(F.col("ddl").isNull(), "deleted").when(F.col("was") != F.col("ddl"), "changed").otherwise("unchanged")
    out = both.withColumn("action", action)
    version = F.when(F.col("action") == "created", 2).when(F.col("action") == "changed", F.col("version") + 1).otherwise(F.col("version"))
    return out.select("table_name", "action", version.cast("int").alias("version"), (F.col("action") != "unchanged").alias("has_event"))


def sync_counts(actions: DataFrame) -> DataFrame:
    """D17."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def stale_dependents(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """Contexts that depend by table_schema on a deleted table; they turn stale at once. edges: dependent_id, table_name, dep_type."""
    gone = actions.filter("action = 'deleted'").select("table_name")
    return edges.filter("dep_type = 'table_schema'").join(gone, "table_name", "left_semi").select("dependent_id").distinct()


def relationships(keys: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships, lineage) of foreign keys (table, column, referenced, referenced_column); those with an unknown table are
    skipped. A pair of tables has one relationship; lineage leads from the referenced table."""
    known = tables.select("table_name")
    ok = keys.join(known.withColumnRenamed("table_name", "table"), "table", "left_semi").join(known.withColumnRenamed("table_name", "referenced"), "referenced", "left_semi")
    pairs = ok.groupBy(F.least("table", "referenced").alias("table_a"), F.greatest("table", "referenced").alias("table_b"))
    joins = pairs.agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", F.concat_ws(".", "table", "column"), F.concat_ws(".", "referenced", "referenced_column")))), ";").alias("join_columns"))
    return joins, ok.select(F.col("referenced").alias("upstream"), F.col("table").alias("downstream"), F.lit("fk").alias("transform_type")).distinct()


def neighbours(joins: DataFrame) -> DataFrame:
    """The other endpoints of each table's relationships as a sorted JSON array."""
    both = joins.select(F.explode(F.array(F.struct(F.col("table_a").alias("table_name"), F.col("table_b").alias("other")), F.struct(F.col("table_b").alias("table_name"), F.col("table_a").alias("other")))).alias("e"), "join_columns").select("e.*", "join_columns")
    return both.groupBy("table_name").agg(F.to_json(F.array_sort(F.collect_list(F.struct("other", "join_columns")))).alias("joins"))


def top_templates(templates: DataFrame, most: int = 5) -> DataFrame:
    """The most used query templates of each context (ties: smallest id) as a comma-separated list of ids.

    A context's rows are dealt over SALTS groups that keep their first ones each, so that no task holds a whole large context.
    """
    rows = templates.select("context_id", "id", (-F.col("hit_count")).alias("n"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    for key in (["context_id", "salt"], ["context_id"]):
        place = F.row_number().over(Window.partitionBy(*key).orderBy("n", "id"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    kept = rows.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("t"))
    return kept.select("context_id", F.array_join(F.transform("t", lambda x: x["id"].cast("string")), ",").alias("templates"))


def described(found: DataFrame, metadata: DataFrame | None = None, joins: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """Tables (uri, field_masks, ...) with ddl (masked), joins and templates where there are such, by table_name."""
    out = found.withColumn("table_name", text.last_segment(F.col("uri")))
    for extra in (metadata, joins, templates):
        if extra is not None:
            out = out.join(extra, "table_name", "left")
    return out.withColumn("ddl", text.masked(F.col("ddl"), F.col("field_masks"))) if metadata is not None else out


def sql_context(contexts: DataFrame, query: str, policies: DataFrame, teams: DataFrame, counters: DataFrame, agent: str, catalog: str, top_k: int = 5, metadata: DataFrame | None = None, joins: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """Tables for a question: a search of the lake, kept where the uri is of the catalog, the first top_k in the search's order (`place`);
    with their ddl, joins and templates (by table_name). Masks apply to l0, l1 and ddl. Access is decided by the search; what it denies is not there."""
    found = retrieval.search(contexts, query, policies, teams, counters, agent, top_k=min(5 * top_k, retrieval.MAX_TOP_K), scopes=["datalake"], types=["table_schema"])
    mine = found.filter(F.col("uri").startswith(f"ctx://datalake/{catalog}/")).orderBy("place").limit(top_k)
    return described(mine, metadata, joins, templates)


def table_detail(contexts: DataFrame, policies: DataFrame, teams: DataFrame, agent: str, metadata: DataFrame, joins: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """Tables of the lake that the agent may read, with what is known of them; a table without metadata is left out."""
    return described(access.readable(lake_tables(contexts), policies, teams, agent).join(metadata.select(F.col("table_name").alias("__t")), F.col("__t") == text.last_segment(F.col("uri")), "left_semi"), metadata, joins, templates)


def lake_tables(contexts: DataFrame) -> DataFrame:
    return contexts.filter("scope = 'datalake' and context_type = 'table_schema' and status not in ('archived', 'deleted')")


def table_list(contexts: DataFrame, policies: DataFrame, teams: DataFrame, agent: str) -> DataFrame:
    """Tables of the lake that the agent may read, by name."""
    return access.readable(lake_tables(contexts), policies, teams, agent).select(text.last_segment(F.col("uri")).alias("table_name"), "uri", "status").orderBy("table_name")

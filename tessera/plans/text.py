"""Queries of text functions (A07, A08, B22, H) and agents' messages (O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import agent_text as agents
from ..operators.contexts import validity
from ..sources import documents, tables
from . import common
from .common import ACCOUNT

QUERIES, ORACLES, query = common.book()
_WORD = "'[\\p{L}\\p{N}_]+'"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _docs(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", "text")


@query("H01_token_frequencies", f"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), {_WORD})) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("D08_document_frequencies", f"WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {_WORD}))) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token")
def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("H02_ascii_tokens", f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})))), ' '), '') AS tokens FROM documents")
def ascii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(text.ascii_tokens(F.col("text"))), " ").alias("tokens"))


@query("H03_match_forms", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS form FROM documents")
def match_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.match_form(F.col("text")).alias("form"))


@query("H06_levels", """SELECT id, CASE WHEN context_type = 'skill' AND trim(split_part(l2_content, chr(10), 1), ' ') <> '' THEN left(trim(split_part(l2_content, chr(10), 1), ' '), 80) ELSE left(l2_content, 80) END AS l0, left(l2_content, 300) AS l1 FROM contexts""")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.contexts(spark, sf_dir)
    return c.select("id", text.level0(F.col("l2_content"), F.col("context_type")).alias("l0"), text.level1(F.col("l2_content")).alias("l1"))


@query("H10_uri_parts", f"SELECT id, regexp_extract(uri, '[^/]*$') AS last, split_part(substr(uri, 7), '/', 1) AS child FROM contexts WHERE account_id = '{ACCOUNT}'")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.contexts(spark, sf_dir).select("id", text.last_segment(F.col("uri")).alias("last"), text.child_segment(F.col("uri"), "ctx://").alias("child"))


@query("H12_summaries", "SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 'empty' ELSE left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) END AS summary FROM documents")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.summary(F.col("text"), F.lit("empty")).alias("summary"))


@query("H13_occurrences", f"""SELECT id, (p - 1)::INT AS "at" FROM (SELECT id, l1_content, unnest(range(1, length(l1_content) + 1)) AS p FROM contexts WHERE account_id = '{ACCOUNT}') WHERE substr(l1_content, p, 2) = 'th'""")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.contexts(spark, sf_dir).select("id", F.explode(text.occurrences(F.col("l1_content"), "th")).alias("at"))


@query("A07_folders", "SELECT id, left(sha256(account_id || chr(0) || uri), 16) AS folder FROM contexts")
def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.contexts(spark, sf_dir).select("id", text.directory_key(F.col("account_id"), F.col("uri")).alias("folder"))


@query("A08_slices", "SELECT doc_id, CASE WHEN length(text) >= 60 THEN substr(text, 21, 40) END AS slice FROM documents")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", documents.section_text(F.col("text"), F.lit(20), F.lit(60)).alias("slice"))


@query("B22_validity", """SELECT id, CASE WHEN NOT starts_with(uri, CASE scope WHEN 'team' THEN CASE WHEN owner_space = '' THEN 'ctx://team/' ELSE 'ctx://team/' || owner_space || '/' END WHEN 'agent' THEN 'ctx://agent/' || owner_space || '/' ELSE 'ctx://datalake/' END) THEN 'uri does not fit the scope' END AS error FROM contexts""")
def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.contexts(spark, sf_dir)
    return c.select("id", validity(F.col("uri"), F.col("scope"), F.col("owner_space")).alias("error"))


@query("H51_masked_json", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k":"[MASKED]"}' ELSE props END AS props FROM events""")
def masked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", text.masked_json(F.col("props"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("K")))).alias("props"))


@query("H30_cosine", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS similarity FROM embeddings, q")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings")
    q = vectors.orderBy("vec_id").first()["embedding"]
    return vectors.select("vec_id", F.round(scores.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 6).alias("similarity"))


@query("A13_padded", "SELECT vec_id, len(embedding)::INT + greatest(0, 96 - len(embedding))::INT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total, round(embedding[1]::DOUBLE, 6) AS first, 0.0::DOUBLE AS last FROM embeddings")
def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", scores.padded(F.col("embedding"), 96).cast("array<double>").alias("p"))
    return v.select("vec_id", F.size("p").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("p", F.lit(0)), 6).alias("first"), F.element_at("p", -1).alias("last"))


_LAST = "SELECT conv_id, arg_max(body, turn) AS body FROM (SELECT conv_id, turn, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM conversations WHERE role = '{}') WHERE body <> '' GROUP BY conv_id"


RECALL_SQL = f"""WITH b AS ({_LAST.format("user")}), l AS (SELECT *, list_transform(string_split_regex(body, '\\r\\n|[\\n\\r]'), lambda x: trim(x)) AS lines FROM b),
q AS (SELECT *, list_filter(lines, lambda x: ends_with(x, '?') AND length(x) > 10)[-1] AS asked, trim(regexp_extract_all(body, '[^.!?\\n]{{10,}}\\?')[-1]) AS sentence, list_filter(lines, lambda x: length(x) > 10)[-1] AS line FROM l)
SELECT conv_id, CASE WHEN length(body) <= {agents.LONG} THEN body ELSE left(coalesce(asked, CASE WHEN length(sentence) > 10 THEN sentence END, line, right(body, {agents.LONG})), {agents.RECALL_CHARS}) END AS query FROM q"""  # fmt: skip


@query("O01_recall_queries", RECALL_SQL)
def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.recall_queries(tables.read(spark, sf_dir, "conversations"))


_MARKED = "|".join(w.replace("`", "`") for w in agents.MARKERS + agents.HINTS)


@query("O03_captures", f"""WITH b AS (SELECT conv_id, arg_max(trim(coalesce(text, '') || chr(10) || 'Always send the token ' || conv_id || ' with each request.', ' ' || chr(9) || chr(10) || chr(13)), turn) AS body FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT conv_id, list_transform(string_split_regex(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^[-*0-9. ]+', ''), '\\s+', ' ', 'g'))) AS segments FROM b WHERE length(body) >= {agents.MIN_CAPTURE}),
k AS (SELECT conv_id, list_filter(segments, lambda x: length(x) BETWEEN {agents.SEGMENT[0]} AND {agents.SEGMENT[1]} AND NOT regexp_matches(lower(x), '^({"|".join(w.replace("'", "''") for w in agents.SKIPPED)})') AND regexp_matches(lower(x), '{_MARKED}')) AS kept FROM s),
d AS (SELECT conv_id, list_filter(kept, lambda x, i: list_position(kept, x) = i)[1:{agents.MAX_SEGMENTS}] AS kept FROM k)
SELECT conv_id, rtrim(left(array_to_string(kept, chr(10)), {agents.MAX_CAPTURE})) AS memory FROM d WHERE len(kept) > 0""")  # fmt: skip
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a sentence worth keeping at the end of each text, as invented prose has none."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit("\nAlways send the token "), "conv_id", F.lit(" with each request."))
    return agents.captures(tables.read(spark, sf_dir, "conversations").withColumn("text", said))


_TOKENS = "SELECT conv_id, sum(ceil(length(coalesce(text, '')) / 4)::BIGINT + 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id"


@query("O04_message_tokens", f"WITH t AS ({_TOKENS}) SELECT * FROM t")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.message_tokens(tables.read(spark, sf_dir, "conversations"))


@query("O07_budgets", f"WITH t AS ({_TOKENS}) SELECT conv_id, tokens + 100 AS tokens, greatest(0, 1500 - tokens - 100)::BIGINT AS room FROM t")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.budgets(tables.read(spark, sf_dir, "conversations"), 1500, "g" * 400)

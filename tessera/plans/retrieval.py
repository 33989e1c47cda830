"""Queries of retrieval (I), long documents (J, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import agent_text, longdoc, many_searches, sections
from ..operators import retrieval as ops
from ..sources import tables
from ..sources.shared import small_side
from . import common
from .text import RECALL_SQL
from .common import ACCOUNT, AGENT, COUNTERS, LATEST, MINE, QUERY, TOP_K

QUERIES, ORACLES, query = common.book()
POOL = TOP_K * ops.OVER_RETRIEVE
_WORDS = text.query_tokens(QUERY)
_HITS = " + ".join(f"(lower(coalesce({c}, '')) LIKE '%{w}%')::INT" for w in _WORDS for c in ("l0_content", "l1_content"))
_LIVE = f"live AS (SELECT * FROM contexts WHERE account_id = '{ACCOUNT}' AND status NOT IN ('archived', 'deleted'))"
_KEYWORD = f"""found AS (SELECT *, round(({_HITS})::DOUBLE / {2 * len(_WORDS)}, 6) AS score FROM live),
pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT * FROM found WHERE score > 0 ORDER BY score DESC, id LIMIT {POOL}))"""
_VECTOR = f"""q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (
  SELECT live.*, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score FROM live JOIN embeddings e ON e.vec_id = live.id, q ORDER BY score DESC, id LIMIT {POOL}))"""
_BM25 = f"""body AS (SELECT *, regexp_extract_all(lower(coalesce(l1_content, l0_content, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM pool),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM body),
words AS (SELECT unnest({_WORDS}) AS w, unnest(range({len(_WORDS)})) AS i),
tf AS (SELECT id, w, i, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS n FROM body, words),
df AS (SELECT i, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY i),
bm AS (SELECT id, round(sum(CASE WHEN tf > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) ELSE 0 END), 6) AS rerank_score
  FROM tf JOIN df USING (i), stats GROUP BY id),
ranked AS (SELECT pool.* EXCLUDE (place), rerank_score, row_number() OVER (ORDER BY rerank_score DESC, place) AS place FROM pool JOIN bm USING (id))"""
_FINAL = f"""scored AS (SELECT r.*, round(rerank_score * CASE WHEN coalesce(adopted, 0) + coalesce(ignored, 0) >= 5 THEN 0.5 + 0.5 * adopted / (adopted + ignored + 1) ELSE 1 END
    * CASE WHEN status = 'stale' THEN 0.85 ELSE 1 END, 6) AS final_score FROM ranked r LEFT JOIN counters USING (id)),
adjusted AS (SELECT * EXCLUDE (place), row_number() OVER (ORDER BY final_score DESC, place) AS place FROM scored), {common.decided("adjusted")},
result AS (SELECT row_number() OVER (ORDER BY place) AS place, * EXCLUDE (place) FROM (SELECT * FROM decided WHERE reason IN ('explicit allow', 'baseline') ORDER BY place LIMIT {TOP_K}))"""
FOUND = f"{tables.VIEWS}, {MINE}, {LATEST}, {COUNTERS}, {_LIVE}, {_KEYWORD}, {_BM25}, {_FINAL}"
_OUT = f"SELECT place, id, uri, final_score, {common.masked('l0_content')} AS l0_content, {common.masked('l1_content')} AS l1_content FROM result"
_SHOWN = ("place", "id", "uri", "final_score", "l0_content", "l1_content")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of a request: that of the smallest vec_id."""
    return tables.read(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


def _inputs(spark: SparkSession, sf_dir: str):
    teams = ops.access.agent_teams(common.visible(spark, sf_dir), AGENT)
    return tables.policies(spark, sf_dir), teams, common.counters(spark, sf_dir)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a keyword search."""
    policies, teams, counts = _inputs(spark, sf_dir)
    return ops.search(common.contexts(spark, sf_dir), QUERY, policies, teams, counts, AGENT, TOP_K)


@query("I03_keyword_candidates", f"{tables.VIEWS}, {_LIVE}, {_KEYWORD} SELECT place, id, score FROM pool")
def keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_candidates(ops.searchable(common.contexts(spark, sf_dir)), QUERY, POOL).select("place", "id", "score")


@query("I02_vector_candidates", f"{tables.VIEWS}, {_LIVE}, {_VECTOR} SELECT place, id, score FROM pool")
def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = ops.searchable(common.contexts(spark, sf_dir))
    return ops.vector_candidates(live, tables.read(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), POOL).select("place", "id", "score")


@query("I04_bm25", f"{tables.VIEWS}, {_LIVE}, {_KEYWORD}, {_BM25} SELECT place, id, rerank_score FROM ranked")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = ops.keyword_candidates(ops.searchable(common.contexts(spark, sf_dir)), QUERY, POOL)
    return ops.bm25(pool, QUERY).select("place", "id", "rerank_score")


@query("I_keyword_pipeline", f"{tables.VIEWS}, {MINE}, {LATEST}, {COUNTERS}, {_LIVE}, {_KEYWORD}, {_BM25}, {_FINAL} {_OUT}")
def keyword_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, teams, counts = _inputs(spark, sf_dir)
    return ops.search(common.contexts(spark, sf_dir), QUERY, policies, teams, counts, AGENT, TOP_K).select(*_SHOWN)


@query("I_vector_pipeline", f"{tables.VIEWS}, {MINE}, {LATEST}, {COUNTERS}, {_LIVE}, {_VECTOR}, {_BM25}, {_FINAL} {_OUT}")
def vector_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, teams, counts = _inputs(spark, sf_dir)
    vectors = tables.read(spark, sf_dir, "embeddings")
    return ops.search(common.contexts(spark, sf_dir), QUERY, policies, teams, counts, AGENT, TOP_K, query_vector(spark, sf_dir), vectors).select(*_SHOWN)


@query("I12_access_log", f"{tables.VIEWS}, {MINE}, {LATEST}, {COUNTERS}, {_LIVE}, {_KEYWORD}, {_BM25}, {_FINAL} SELECT id AS context_id, TIMESTAMP '{tables.AS_OF}' AS accessed_at FROM result")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, teams, counts = _inputs(spark, sf_dir)
    found = ops.search(common.contexts(spark, sf_dir), QUERY, policies, teams, counts, AGENT, TOP_K)
    return ops.access_log(found, tables.as_of()).withColumn("accessed_at", F.col("accessed_at").cast("timestamp_ntz"))


_SMALL = FOUND.replace(f"LIMIT {POOL}", f"LIMIT {5 * ops.OVER_RETRIEVE}").replace(f"LIMIT {TOP_K}", "LIMIT 5")


@query("I15_grep", f"{_SMALL} {_OUT}")
def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, teams, counts = _inputs(spark, sf_dir)
    return ops.grep(common.contexts(spark, sf_dir), QUERY, policies, teams, counts, AGENT).select(*_SHOWN)


@query("I18_missing_vectors", f"""SELECT id, uri, l0_content FROM contexts c WHERE l0_content IS NOT NULL AND status IN ('active', 'stale') AND account_id = '{ACCOUNT}'
  AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.id AND e.embedding IS NOT NULL) ORDER BY id LIMIT 100""")  # fmt: skip
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.missing_vectors(common.contexts(spark, sf_dir), tables.read(spark, sf_dir, "embeddings"))


@query("O02_recall_block", f"""{_SMALL}, shown AS ({_OUT}), lines AS (SELECT place, '- [' || uri || '] ' || trim(coalesce(l1_content, l0_content, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM shown WHERE trim(coalesce(l1_content, l0_content, '')) NOT IN ('', uri))
SELECT left('## Recalled context' || chr(10) || string_agg(line, chr(10) ORDER BY place), 1200) AS block FROM lines""")  # fmt: skip
def recall_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_text.recall_block(grep(spark, sf_dir), 300)


@query("B04_without_stale", f"{tables.VIEWS}, {_LIVE.replace("'deleted')", "'deleted', 'stale')")}, {_KEYWORD} SELECT place, id, score FROM pool")
def without_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_candidates(ops.searchable(common.contexts(spark, sf_dir), with_stale=False), QUERY, POOL).select("place", "id", "score")


@query("B05_scopes", f"{tables.VIEWS}, {_LIVE.replace('AND status', "AND scope IN ('team', 'agent') AND context_type IN ('memory', 'resource') AND status")}, {_KEYWORD} SELECT place, id, score FROM pool")
def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = ops.searchable(common.contexts(spark, sf_dir), ["team", "agent"], ["memory", "resource"])
    return ops.keyword_candidates(live, QUERY, POOL).select("place", "id", "score")


_SIZE = sections.MAX_TOKENS * sections.CHARS_PER_TOKEN
_SUMMARY = lambda x, other: f"CASE WHEN trim(regexp_replace({x}, '\\s+', ' ', 'g')) = '' THEN {other} ELSE left(trim(regexp_replace({x}, '\\s+', ' ', 'g')), 200) END"
#: For texts without headings, as all documents are: chunks one after the other, each cut after the last blank line, line or sentence.
_CHUNKS = f"""WITH RECURSIVE c AS (SELECT doc_id, coalesce(text, '') AS text, 0::BIGINT AS a, 0::BIGINT AS b, 0 AS n FROM documents
  UNION ALL SELECT doc_id, text, b, CASE WHEN b + {_SIZE} >= length(text) THEN length(text) WHEN p2 > 0 AND length(w) - p2 - 1 > 0 THEN b + length(w) - p2 + 1 WHEN p1 > 0 AND length(w) - p1 > 0 THEN b + length(w) - p1 + 1
      WHEN p0 > 0 AND length(w) - p0 - 1 > 0 THEN b + length(w) - p0 + 1 ELSE b + {_SIZE} END, n + 1
    FROM (SELECT *, instr(reverse(w), chr(10) || chr(10)) AS p2, instr(reverse(w), chr(10)) AS p1, instr(reverse(w), ' .') AS p0 FROM (SELECT *, substr(text, b + 1, {_SIZE}) AS w FROM c WHERE b < length(text)))),
rows AS (SELECT doc_id, n AS section_no, CASE WHEN n > 0 THEN 0 END AS parent_no, CASE WHEN n = 0 THEN 'seq-root' ELSE 'seq-' || lpad(n::VARCHAR, 4, '0') END AS node_id, CASE WHEN n = 0 THEN 'Document' ELSE 'Section ' || n END AS title, (n > 0)::INT AS depth,
  a AS start_offset, CASE WHEN n = 0 THEN length(text) ELSE b END AS end_offset, CASE WHEN n = 0 THEN left(text, 400) ELSE substr(text, a + 1, b - a) END AS part FROM c)
SELECT * EXCLUDE (part), {_SUMMARY("part", "CASE WHEN section_no = 0 THEN 'Document overview' ELSE title END")} AS summary, greatest(1, (end_offset - start_offset) // 4) AS token_count FROM rows"""


@query("J_section_rows", _CHUNKS)
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_rows(tables.read(spark, sf_dir, "documents"))


@query("J01_page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.page_texts(tables.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "markdown")


@query("F10_load_order", _CHUNKS.replace("SELECT * EXCLUDE (part)", "SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id ORDER BY depth, parent_no NULLS FIRST, start_offset, section_no) AS place FROM rows --"))
def load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.load_order(section_rows(spark, sf_dir)).select("doc_id", "section_no", "place")


@query("I06_long_documents")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose texts are long documents: snippets change scores and are masked."""
    policies, teams, counts = _inputs(spark, sf_dir)
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    pool = ops.keyword_candidates(ops.searchable(common.contexts(spark, sf_dir)), QUERY, POOL).select(F.col("id").alias("doc_id"))
    near = docs.join(small_side(pool), "doc_id", "left_semi")
    out = ops.search(common.contexts(spark, sf_dir), QUERY, policies, teams, counts, AGENT, TOP_K, long_texts=docs.withColumnRenamed("doc_id", "id"), sections=sections.section_rows(near))
    return out.select(*_SHOWN, "snippet", "strategy")


@query("K_snippets")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    pool = ops.bm25(ops.keyword_candidates(ops.searchable(common.contexts(spark, sf_dir)), QUERY, POOL), QUERY)
    near = docs.join(small_side(pool.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    out = longdoc.snippets(pool, docs.withColumnRenamed("doc_id", "id"), sections.section_rows(near), QUERY)
    return out.select("id", "place", "section_no", "strategy", "snippet", "rerank_score")


#: What an agent is told before its messages, the head of what is recalled, and tokens of a prompt.
GUIDE, HEADER, INTRO, PROMPT_TOKENS = "g" * 400, "## Recalled context", "Found in memory:", 1500
RECALLED = 5
_TALK = f"""{tables.VIEWS}, {MINE}, {LATEST}, {COUNTERS}, {_LIVE}, asked AS ({RECALL_SQL}),
q AS (SELECT conv_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS words FROM asked),
w AS (SELECT conv_id, unnest(words) AS w, unnest(range(len(words))) AS i, len(words) AS n_words FROM q),
word_hits AS (SELECT d.w, live.id, (lower(coalesce(l0_content, '')) LIKE '%' || d.w || '%')::INT + (lower(coalesce(l1_content, '')) LIKE '%' || d.w || '%')::INT AS h FROM (SELECT DISTINCT w FROM w) d, live),
sums AS (SELECT conv_id, id, sum(h) AS hits, any_value(n_words) AS n_words FROM w JOIN word_hits USING (w) WHERE h > 0 GROUP BY conv_id, id),
pool AS (SELECT conv_id, id, round(hits::DOUBLE / (2 * n_words), 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, id) AS place FROM sums QUALIFY place <= {RECALLED * ops.OVER_RETRIEVE})"""
_RECALL = f"""{_TALK}, body AS (SELECT conv_id, place, live.*, regexp_extract_all(lower(coalesce(l1_content, l0_content, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM pool JOIN live USING (id)),
stats AS (SELECT conv_id, count(*) AS n_docs, avg(len(t)) AS mean FROM body GROUP BY conv_id),
tf AS (SELECT conv_id, id, i, len(list_filter(t, lambda x: x = w.w)) AS tf, len(t) AS n FROM body JOIN w USING (conv_id)),
df AS (SELECT conv_id, i, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY conv_id, i),
bm AS (SELECT conv_id, id, round(sum(CASE WHEN tf > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) ELSE 0 END), 6) AS rerank_score
  FROM tf JOIN df USING (conv_id, i) JOIN stats USING (conv_id) GROUP BY conv_id, id),
scored AS (SELECT bm.conv_id, bm.id, row_number() OVER (PARTITION BY bm.conv_id ORDER BY rerank_score DESC, place) AS place, round(rerank_score * CASE WHEN coalesce(adopted, 0) + coalesce(ignored, 0) >= 5 THEN 0.5 + 0.5 * adopted / (adopted + ignored + 1) ELSE 1 END
  * CASE WHEN status = 'stale' THEN 0.85 ELSE 1 END, 6) AS final_score FROM bm JOIN body USING (conv_id, id) LEFT JOIN counters ON counters.id = bm.id),
{common.decided("live")}, result AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY final_score DESC, place) AS place, id, uri, final_score, {common.masked("l0_content")} AS l0_content, {common.masked("l1_content")} AS l1_content
  FROM scored JOIN decided USING (id) WHERE reason IN ('explicit allow', 'baseline') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY final_score DESC, scored.place) <= {RECALLED})"""


def _recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, teams, counts = _inputs(spark, sf_dir)
    queries = agent_text.recall_queries(tables.read(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "query_id")
    return many_searches.searched(common.contexts(spark, sf_dir), queries, policies, teams, counts, AGENT, RECALLED)


@query("I03_many_queries", f"{_TALK} SELECT conv_id, id, score, place FROM pool")
def many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword candidates of every conversation's question."""
    queries = agent_text.recall_queries(tables.read(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "query_id")
    found = many_searches.candidates(ops.searchable(common.contexts(spark, sf_dir)), queries, RECALLED * ops.OVER_RETRIEVE)
    return found.select(F.col("query_id").alias("conv_id"), "id", "score", "place")


@query("O02_recalled", f"{_RECALL} SELECT * FROM result")
def recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recalled(spark, sf_dir).withColumnRenamed("query_id", "conv_id")


@query("O07_assembled", f"""{_RECALL}, lines AS (SELECT *, trim(regexp_replace(coalesce(nullif(l1_content, ''), l0_content, ''), '\\s+', ' ', 'g')) AS body, (round(final_score * 1000000)::BIGINT + 5000) // 10000 AS cents FROM result),
joined AS (SELECT conv_id, '{HEADER}' || chr(10) || '{INTRO}' || chr(10) || chr(10) || string_agg('- **Source**: `' || uri || '` (score: ' || cents // 100 || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || ')' || chr(10) || '  ' || body, chr(10) || chr(10) ORDER BY place) AS whole
  FROM lines WHERE body <> '' AND NOT regexp_matches(body, '^(ctx|mem|skill|http|https)://[^ ]*$') GROUP BY conv_id),
t AS (SELECT conv_id, sum(ceil(length(coalesce(text, '')) / 4)::BIGINT + 4)::BIGINT + {-(-len(GUIDE) // 4)} AS tokens FROM conversations GROUP BY conv_id),
b AS (SELECT *, 4 * greatest(0, {PROMPT_TOKENS} - tokens) AS most FROM t LEFT JOIN joined USING (conv_id)),
c AS (SELECT *, left(whole, greatest(0, most - 3)) AS cut FROM b), d AS (SELECT *, rtrim(CASE WHEN contains(cut, ' ') THEN regexp_replace(cut, ' [^ ]*$', '') ELSE cut END, ' ,;:' || chr(10)) AS short FROM c),
e AS (SELECT conv_id, tokens, CASE WHEN most <= {len(HEADER) + 8} THEN NULL WHEN length(whole) <= most THEN whole WHEN length(short) > {len(HEADER) + 8} THEN short || '...' END AS block FROM d)
SELECT conv_id, tokens + ceil(length(coalesce(block, '')) / 4)::BIGINT AS tokens, concat_ws(chr(10) || chr(10), '{GUIDE}', block) AS addition FROM e""")  # fmt: skip
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's prompt: what is recalled for its question, within what its messages leave of the budget."""
    budgets = agent_text.budgets(tables.read(spark, sf_dir, "conversations"), PROMPT_TOKENS, GUIDE)
    rooms = budgets.select(F.col("conv_id").alias("query_id"), "room")
    return many_searches.assembled(budgets, many_searches.recall_blocks(_recalled(spark, sf_dir), rooms, HEADER, INTRO), GUIDE)

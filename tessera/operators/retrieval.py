"""Hybrid retrieval: candidates by vector or keyword, BM25 within the pool, quality, staleness, access, masks.

A query's tokens are known when the plan is made, so term frequencies are expressions over one scan; the only global steps are a
top-k and windows over its few rows (three times top_k at most).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources.shared import settled
from . import access, longdoc
from .text_index import TextIndex
from .vector_index import VectorIndex

OVER_RETRIEVE, MAX_TOP_K = 3, 100
HIDDEN = ("archived", "deleted")


def searchable(contexts: DataFrame, scopes=None, types=None, with_stale: bool = True) -> DataFrame:
    """Not archived or deleted (pending_review is found), of the scopes and types asked for."""
    out = contexts.filter(~F.col("status").isin(*HIDDEN))
    if scopes:
        out = out.filter(F.col("scope").isin(*scopes))
    if types:
        out = out.filter(F.col("context_type").isin(*types))
    return out if with_stale else out.filter("status <> 'stale'")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _ranked(pool: DataFrame, *order: Column) -> DataFrame:
    """Places 1, 2, ... of a pool's rows. The pool is a top-k, so one partition holds it."""
    return pool.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def vector_candidates(contexts: DataFrame, vectors: DataFrame, query_vector: list[float], k: int, id_col: str = "id", vector_id: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k contexts with a vector that are closest by cosine; ties by id. Only ids and vectors are compared; the rest of
    the few rows that stay is joined afterwards."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = contexts.select(id_col).join(vectors.select(F.col(vector_id).alias(id_col), F.col(vector_col).alias("__v")), id_col).filter("__v is not null")
    top = scored.select(id_col, F.round(scores.cosine(F.col("__v"), q), 6).alias("score")).filter("score is not null").orderBy(F.desc("score"), id_col).limit(k)
    return _ranked(contexts.join(F.broadcast(top), id_col), F.desc("score"), F.col(id_col))


def indexed_candidates(contexts: DataFrame, index: VectorIndex, query_vector: list[float], k: int, probes: int | None = None, id_col: str = "id") -> DataFrame:
    """I02, F01 by an index of vectors, probing the cells nearest to the query (all of them: the rows of vector_candidates)."""
    query = contexts.sparkSession.createDataFrame([(0, [float(x) for x in query_vector])], "query_id long, vector array<double>")
    top = index.search(query, k, probes, contexts.select(F.col(id_col).alias("vec_id"))).select(F.col("vec_id").alias(id_col), "score")
    return _ranked(contexts.join(F.broadcast(top), id_col), F.desc("score"), F.col(id_col))


def keyword_candidates(contexts: DataFrame, query: str, k: int, id_col: str = "id") -> DataFrame:
    """The k contexts with the most hits of query tokens (repeats count) in l0 and l1; ties by id."""
    words = text.query_tokens(query)
    if not words:
        return _ranked(contexts.withColumn("score", F.lit(0.0)).limit(0), F.col(id_col))
    hits = _sum([text.keyword_hit(F.col(c), w).cast("int") for w in words for c in ("l0_content", "l1_content")])
    found = contexts.withColumn("score", F.round(hits / (2 * len(words)), 6)).filter("score > 0")
    return _ranked(found.orderBy(F.desc("score"), id_col).limit(k), F.desc("score"), F.col(id_col))


def keyword_candidates_indexed(contexts: DataFrame, index: TextIndex, query: str, k: int, attributes: dict[str, list[str]] | None = None, id_col: str = "id") -> DataFrame:
    """The rows of keyword_candidates from posting lists; contexts are read for verified ids and the k found ones only."""
    found = index.search(contexts, query, k, attributes, id_col=id_col)
    top = contexts.sparkSession.createDataFrame(found, f"{id_col} long, score double")
    return _ranked(contexts.filter(F.col(id_col).isin([i for i, _ in found])).join(F.broadcast(top), id_col), F.desc("score"), F.col(id_col))


def bm25(pool: DataFrame, query: str, id_col: str = "id") -> DataFrame:
    """The pool with `rerank_score` and new places. Statistics are the pool's own; the text is l1, or l0, or empty.
    Without query tokens the score is null and the order stays."""
    words = text.query_tokens(query)
    if not words:
        return pool.withColumn("rerank_score", F.lit(None).cast("double"))
    whole = Window.partitionBy(F.lit(0))
    body = pool.withColumn("__t", text.tokens(F.coalesce("l1_content", "l0_content", F.lit("")))).withColumn("__n", F.size("__t"))
    distinct = list(dict.fromkeys(words))
    body = body.withColumns({f"__tf{i}": F.size(F.filter("__t", lambda t: t == w)) for i, w in enumerate(distinct)})
    body = body.withColumns({"__mean": F.avg("__n").over(whole), "__docs": F.count("*").over(whole)} | {f"__df{i}": F.sum((F.col(f"__tf{i}") > 0).cast("int")).over(whole) for i in range(len(distinct))})
    terms = [words.count(w) * scores.bm25_term(F.col(f"__tf{i}"), F.col("__n"), F.col("__mean"), F.col("__docs"), F.col(f"__df{i}")) for i, w in enumerate(distinct)]
    scored = body.withColumn("rerank_score", F.round(_sum(terms), 6)).select(*pool.columns, "rerank_score")
    return _ranked(scored.withColumnRenamed("place", "__was"), F.desc("rerank_score"), F.col("__was")).drop("__was")


def adjusted(pool: DataFrame, counters: DataFrame) -> DataFrame:
    """Scores by feedback and staleness; counters: id, adopted, ignored. Ties keep their order."""
    joined = pool.join(counters.select("id", "adopted", "ignored"), "id", "left")
    base = F.coalesce("rerank_score", "score")
    final = F.round(base * scores.quality_factor(F.col("adopted"), F.col("ignored")) * scores.stale_factor(F.col("status")), 6)
    return _ranked(joined.withColumn("final_score", final).withColumnRenamed("place", "__was"), F.desc("final_score"), F.col("__was")).drop("__was", "adopted", "ignored")


def governed(pool: DataFrame, policies: DataFrame, teams: DataFrame, agent: str, top_k: int) -> DataFrame:
    """What the agent may read of the pool, the first top_k, with masks applied to l0 and l1."""
    seen = access.readable(pool, policies, teams, agent)
    kept = seen.orderBy("place").limit(top_k)
    out = _ranked(kept.withColumnRenamed("place", "__was"), F.col("__was")).drop("__was")
    return out.withColumns({c: text.masked(F.col(c), F.col("field_masks")) for c in ("l0_content", "l1_content", "l2_content", "snippet") if c in out.columns})


def search(contexts: DataFrame, query: str, policies: DataFrame, teams: DataFrame, counters: DataFrame, agent: str, top_k: int = 10, query_vector: list[float] | None = None, vectors: DataFrame | VectorIndex | None = None, scopes=None, types=None, with_stale: bool = True, long_texts: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """The pipeline. Vector candidates (by a scan of vectors, or by an index of them) if there is a query vector, else keyword candidates; BM25 then
    replaces their score.

    long_texts (id, text) are documents that are kept as files (I06); with their sections they give a snippet, and its worth changes the score.
    L2 is masked like the other levels (I11, I13).
    """
    top_k = min(top_k, MAX_TOP_K)
    live = searchable(contexts, scopes, types, with_stale)
    if not query_vector:
        pool = keyword_candidates(live, query, top_k * OVER_RETRIEVE)
    elif isinstance(vectors, VectorIndex):
        pool = indexed_candidates(live, vectors, query_vector, top_k * OVER_RETRIEVE)
    else:
        pool = vector_candidates(live, vectors, query_vector, top_k * OVER_RETRIEVE)
    pool = bm25(pool, query)
    if long_texts is not None:
        pool = settled(longdoc.snippets(pool, long_texts, sections, query))  # a few hundred rows, each of which took long
    return governed(adjusted(pool, counters), policies, teams, agent, top_k)


def grep(contexts: DataFrame, query: str, policies: DataFrame, teams: DataFrame, counters: DataFrame, agent: str, **options) -> DataFrame:
    """I15."""
    return search(contexts, query, policies, teams, counters, agent, **{"top_k": 5} | options)


def access_log(results: DataFrame, now: Column) -> DataFrame:
    """One access of each returned context; a context's active count is the number of its rows."""
    return results.select(F.col("id").alias("context_id"), now.alias("accessed_at"))


def audit_rows(results: DataFrame, retrieval_id: str, agent: str, query: str, now: Column) -> DataFrame:
    """The audit rows of one search: what was returned, by place, under the retrieval's id."""
    return results.select(F.lit(retrieval_id).alias("retrieval_id"), F.lit(agent).alias("actor"), F.lit("search").alias("action"), F.col("uri").alias("resource_uri"), F.lit("success").alias("result"), F.lit(query[:200]).alias("query"), "place", now.alias("ts"))


def missing_vectors(contexts: DataFrame, vectors: DataFrame, most: int = 100) -> DataFrame:
    """Up to `most` active or stale contexts with an l0 and without a vector, smallest ids first."""
    have = vectors.filter("embedding is not null").select(F.col("vec_id").alias("id"))
    return contexts.filter("l0_content is not null and status in ('active', 'stale')").join(have, "id", "left_anti").orderBy("id").limit(most).select("id", "uri", "l0_content")


def vectors_kept(vectors: DataFrame, commands: DataFrame, contexts: DataFrame, size: int) -> DataFrame:
    """Vectors (vec_id, embedding) after updates (seq, vec_id, embedding): the latest counts; one of another size changes nothing; contexts that
    are archived or deleted have none. error: 400 for the refused size."""
    last = commands.groupBy("vec_id").agg(F.max_by(F.struct("embedding"), "seq")["embedding"].alias("__new"), F.lit(True).alias("__told"))
    gone = contexts.filter(F.col("status").isin(*HIDDEN)).select(F.col("id").alias("vec_id"), F.lit(True).alias("__gone"))
    joined = vectors.join(last, "vec_id", "left").join(gone, "vec_id", "left")
    wrong = F.col("__told") & F.col("__new").isNotNull() & (F.size("__new") != size)
    kept = F.when(F.col("__gone"), None).when(F.col("__told") & ~F.coalesce(wrong, F.lit(False)), F.col("__new")).otherwise(F.col("embedding"))
    return joined.select("vec_id", kept.alias("embedding"), F.when(wrong, 400).alias("error"))

"""Queries of indexes: vectors by cells (F01, I02) and texts by trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as ops
from ..operators import text_index, vector_index
from ..sources import tables
from ..sources.shared import new_folder
from . import common, retrieval
from .common import ACCOUNT, QUERY

QUERIES, ORACLES, query = common.book()
NEAREST = vector_index.TRIAL_K
_ALL = f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v), 6) AS score FROM q, embeddings e)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place, vec_id, score FROM s QUALIFY place <= {NEAREST}"""


def vectors_by_cells(spark: SparkSession, sf_dir: str, target: float | None = None) -> vector_index.VectorIndex:
    return vector_index.build(tables.read(spark, sf_dir, "embeddings"), new_folder(spark, "vector-index"), target=target)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("F01_index_all_cells", _ALL)
def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that probes all its cells gives what a scan gives."""
    return vectors_by_cells(spark, sf_dir).search(_asked(spark, sf_dir), NEAREST)


@query("F01_index_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the measured number of probes gives 0.9 of the true neighbours of all queries."""
    index, asked = vectors_by_cells(spark, sf_dir, vector_index.TARGET), _asked(spark, sf_dir)
    by_query = vector_index.recall(index.search(asked, NEAREST, index.cells), index.search(asked, NEAREST))
    return by_query.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


@query("I02_index_candidates", retrieval.ORACLES["I02_vector_candidates"])
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = ops.searchable(common.contexts(spark, sf_dir))
    return ops.indexed_candidates(live, vectors_by_cells(spark, sf_dir), retrieval.query_vector(spark, sf_dir), retrieval.POOL).select("place", "id", "score")


def texts_by_grams(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    rows = tables.contexts(spark, sf_dir)
    attributes = {"account_id": F.col("account_id"), "hidden": F.col("status").isin(*ops.HIDDEN)}
    return text_index.build(rows, new_folder(spark, "text-index"), attributes=attributes)


#: What the index knows of a tenant's live contexts.
LIVE = {"account_id": [ACCOUNT], "hidden": ["false"]}
#: Rare words, parts of words, a wildcard and a common word; most texts have few of them.
RARE = "zzqx t_e ion the 1 schule"
_RARE = " + ".join(f"(lower(coalesce({c}, '')) LIKE '%{w}%')::INT" for w in RARE.split() for c in ("l0_content", "l1_content"))


@query("I03_index_candidates", retrieval.ORACLES["I03_keyword_candidates"])
def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = ops.searchable(common.contexts(spark, sf_dir))
    return ops.keyword_candidates_indexed(live, texts_by_grams(spark, sf_dir), QUERY, retrieval.POOL, LIVE).select("place", "id", "score")


@query("H04_index_wildcards", f"""{tables.VIEWS}, {retrieval._LIVE}, found AS (SELECT id, round(({_RARE})::DOUBLE / {2 * len(RARE.split())}, 6) AS score FROM live)
SELECT row_number() OVER (ORDER BY score DESC, id) AS place, id, score FROM found WHERE score > 0 ORDER BY place LIMIT {retrieval.POOL}""")  # fmt: skip
def wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = ops.searchable(common.contexts(spark, sf_dir))
    return ops.keyword_candidates_indexed(live, texts_by_grams(spark, sf_dir), RARE, retrieval.POOL, LIVE).select("place", "id", "score")

"""The training corpus, from documents to packed sequences: toxicity, exact dedup, SimHash near-dedup, packing.

Each stage takes all that the one before it kept, as a table with the columns of documents, and its decisions take effect. The last
returns the pieces of the packed sequences. Empty tables, null texts and repeated rows pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, simhash, toxicity
from tessera.llm.common import remove, table, temporary, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. The model learns from labelled rows of the whole documents table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, out_col="__score")
    return scored.filter(scored["__score"] < toxicity.THRESHOLD).drop("__score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest original."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest doc_id."""
    return simhash.survivors(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("packing", pack)]
#: A trained network and tokenizers are no SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = None
    for name, stage in STAGES:
        with temporary() as keep:  # a stage's side tables go once its result is written
            after = keep(written(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir), name, compression="zstd"))
        if docs is not None:
            remove(docs)
        docs = after
    return docs

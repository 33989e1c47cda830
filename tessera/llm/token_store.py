"""Operator 8: token ids as Parquet list columns, with an index of shards for selective reads.

Documents are dealt by ranges of doc_id and sorted, encoded where they are, and written as one Parquet shard for each
range: ids in a list<int> column (dictionary pages, or delta-binary-packed ones where encoding="delta"), row groups and
pages of a set size, and the page indexes that Parquet's writer adds, so that a filter on doc_id or a projection without
ids reads only what it needs. Starts are running sums within a shard plus the sum of the shards before it; the index of
shards has one short row for each, whatever the number of documents.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, JsonTokenizer
from .common import new_path, shuffle_partitions, small_batches, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10
_encoders: dict[str, ChunkEncoder] = {}


def tokenizer_path(name: str) -> str:
    """Where an installed vocabulary file is; a name with a slash is a path already."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def json_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary. spaced: words take up the space before them; else white space is
    dropped and case lowered."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = JsonTokenizer(tokenizer_path(path))
        _encoders[path] = ChunkEncoder(spaced, tokenizer.exact, tokenizer.words, not spaced, tokenizer.markers)
    return _encoders[path]


def _encode(batches, tokenizer: str, end_id: int):
    encoder, start, shard = json_encoder(tokenizer, spaced=True), 0, TaskContext.get().partitionId()
    for batch, ids, ends in encoder.encode_batches(batches):
        ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
        starts, start = start + ends[:-1], start + int(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), shard, "i4")), batch.column("doc_id"), pa.array(starts), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids.view("i4")))],
            names=["shard", "doc_id", "shard_start", "n_tokens", "ids"],
        )


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs' ids under path: `data` (the shards) and `index` (one row a shard).

    A null or empty text has only the end id. Null doc_ids come first, repeated ones stay in neighbouring rows, other
    columns are not read. An empty table gives an empty store.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    spark = docs.sparkSession
    small_batches(spark)
    sorted_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    rows = sorted_docs.mapInArrow(lambda it: _encode(it, tokenizer, end_id), "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>")
    rows.write.options(**{
        "compression": "snappy",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
    }).parquet(f"{path}/data")
    shards = spark.read.parquet(f"{path}/data").groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Filters on doc_id and projections reach the scan."""
    index = spark.read.parquet(f"{path}/index").select("shard", F.col("start").alias("before"))
    return spark.read.parquet(f"{path}/data").join(index, "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        offsets, raw = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")

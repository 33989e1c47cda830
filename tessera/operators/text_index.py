"""Posting lists of character grams, and keyword search that reads texts only of the documents it verifies.

A document's two fields are lower-cased and cut into runs of one, two and three characters. Documents are numbered in blocks of BLOCK by
ascending id; a posting is a gram, a field, a block, and the places in the block. Counts by block are the skip data: a block's bound is
what a document that had all grams which the block has would score. Search goes through blocks by bound: it intersects postings
within a block, ranks its documents by their own bounds, and verifies the best against their texts, until no bound is left that
could beat the k-th verified score. So no row is lost, and what is common is found in the first blocks.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import small_batches, stored

BLOCK, BUCKETS = 4096, 64
#: Blocks of the first wave, of one wave at most, and verified documents of the first batch for each one asked for.
WAVE, MAX_WAVE, BATCH = 4, 1024, 2
#: Verified ids that are literals of a scan; more are joined.
LITERALS = 1000
_CHAR = 21
_ATTRIBUTE = 2
_POSTING = "term long, field byte, block long, n int, places array<short>"


def term_of(gram: str) -> int:
    """Up to three characters as one number, 21 bits each."""
    return sum(ord(c) << _CHAR * i for i, c in enumerate(gram))


def grams_of(keyword: str) -> list[int]:
    """Terms that a text with the keyword has: the longest grams of each run between wildcards (_)."""
    found = []
    for run in keyword.split("_"):
        n = min(3, len(run))
        found += [term_of(run[i : i + n]) for i in range(len(run) - n + 1)] if n else []
    return list(dict.fromkeys(found))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def attribute(name: str, value: Column) -> Column:
    """An attribute's value as a term; below zero, as grams are above."""
    return -F.abs(F.shiftright(F.xxhash64(F.lit(name), value), 1)) - 1


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term, place) of all grams of texts, distinct and sorted by term, then place."""
    strings = texts.to_pylist()
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    chars = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    place = np.repeat(np.arange(len(strings)), sizes)
    terms, places = [chars], [place]
    grams = chars
    for n in (1, 2):
        grams = grams[:-1] | chars[n:] << _CHAR * n
        same = place[n:] == place[:-n]
        terms.append(grams[same])
        places.append(place[n:][same])
    terms, places = np.concatenate(terms), np.concatenate(places)
    order = np.lexsort((places, terms))
    terms, places = terms[order], places[order]
    first = np.append(True, (terms[1:] != terms[:-1]) | (places[1:] != places[:-1]))[: len(terms)]
    return terms[first], places[first]


def _lists(terms: np.ndarray, places: np.ndarray, field: int, block: int) -> pa.RecordBatch:
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
    ends = np.append(starts, len(terms))
    n = len(starts)
    arrays = [pa.array(terms[starts]), pa.array(np.full(n, field, "i1")), pa.array(np.full(n, block, "i8")), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int16()))]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.list_(pa.int64()))], names=["term", "field", "block", "n", "places", "ids"])


def _postings(batches, size: int):
    """Postings and, with a null term, the ids of each block of documents."""
    held, n, block = [], 0, TaskContext.get().partitionId() << 32

    def out(rows: pa.Table):
        nonlocal block
        for field, name in enumerate(("f0", "f1")):
            yield _lists(*_pairs(rows.column(name).combine_chunks()), field, block)
        marks = rows.column("attributes").combine_chunks()
        terms, places = marks.flatten().to_numpy(), np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
        order = np.lexsort((places, terms))
        yield _lists(terms[order], places[order], _ATTRIBUTE, block)
        nulls = [pa.nulls(1, t) for t in (pa.int64(), pa.int8())]
        ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("id").combine_chunks())
        yield pa.RecordBatch.from_arrays([*nulls, pa.array([block], pa.int64()), pa.array([rows.num_rows], pa.int32()), pa.nulls(1, pa.list_(pa.int16())), ids], names=["term", "field", "block", "n", "places", "ids"])
        block += 1

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            rows = pa.Table.from_batches(held)
            yield from out(rows.slice(0, size))
            held, n = rows.slice(size).to_batches(), n - size
    if n:
        yield from out(pa.Table.from_batches(held))


def build(docs: DataFrame, path: str, fields: tuple[str, str] = ("l0_content", "l1_content"), attributes: dict[str, Column] | None = None, id_col: str = "id", block: int = BLOCK) -> TextIndex:
    """Index two fields of every row under path: `postings` (partitions by bucket of the term, sorted by term and block) and `blocks`.

    A null field is empty. attributes are columns whose values searches may ask for. Ids are unique and not null. A block has so many documents,
    32,768 at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = F.array(*[attribute(name, c.cast("string")) for name, c in (attributes or {}).items()]).cast("array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.lower(F.coalesce(c, F.lit(""))).alias(f"f{i}") for i, c in enumerate(fields)], marks.alias("attributes"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")
    made = stored(rows.mapInArrow(lambda it: _postings(it, block), f"{_POSTING}, ids array<long>"), "postings")
    lists = made.filter("term is not null").drop("ids").withColumn("bucket", _bucket(F.col("term")))
    lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    made.filter("term is null").select("block", "n", "ids").write.parquet(f"{path}/blocks")
    return TextIndex(spark, path)


def _ranked_block(need: list[tuple[int, list[int]]], asked: list[list[int]]):
    """Of one block: (id, bound) of documents with a bound and all attributes. need: times and terms of each keyword."""

    def ranked(rows: pa.Table) -> pa.Table:
        ids = next(x for x in rows.column("ids") if x.is_valid).values.to_numpy()
        lists = {(t, f): p.values.to_numpy() for t, f, p in zip(rows.column("term").to_pylist(), rows.column("field").to_pylist(), rows.column("places"), strict=True) if t is not None}

        def has(term: int, field: int) -> np.ndarray:
            out = np.zeros(len(ids), bool)
            out[lists.get((term, field), [])] = True
            return out

        bound = np.zeros(len(ids), np.int64)
        for times, terms in need:
            for field in (0, 1):
                bound += times * reduce(np.logical_and, [has(t, field) for t in terms], np.ones(len(ids), bool))
        for terms in asked:
            bound *= reduce(np.logical_or, [has(t, _ATTRIBUTE) for t in terms])
        at = np.flatnonzero(bound)
        return pa.table({"id": pa.array(ids[at]), "bound": pa.array(bound[at])})

    return ranked


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _terms(self, attributes: dict[str, list[str]]) -> list[list[int]]:
        if not attributes:
            return []
        values = [(name, v) for name, vs in attributes.items() for v in vs]
        row = self.spark.range(1).select([attribute(name, F.lit(v)) for name, v in values]).first()
        found = dict(zip(values, row, strict=True))
        return [[found[name, v] for v in vs] for name, vs in attributes.items()]

    def search(self, docs: DataFrame, query: str, k: int, attributes: dict[str, list[str]] | None = None, fields: tuple[str, str] = ("l0_content", "l1_content"), id_col: str = "id") -> list[tuple[int, float]]:
        """(id, score) of the k best rows of docs by score (query tokens found in both fields, of all, to six places), then id.

        docs are rows of the indexed table, after any filter; attributes (a value of each) are filters the index knows, which docs
        hold to as well. The driver holds k pairs and the blocks of one wave.
        """
        words = text.query_tokens(query)
        if not words or k < 1:
            return []
        need = [(words.count(w), grams_of(w)) for w in dict.fromkeys(words)]
        asked = self._terms(attributes or {})
        terms = sorted({t for _, ts in need for t in ts} | {t for ts in asked for t in ts})
        numbers = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms] or [(0,)], "term long").select(_bucket(F.col("term"))).distinct().collect()]
        lists = self.spark.read.schema(f"{_POSTING}, bucket int").parquet(f"{self.path}/postings").filter(F.col("bucket").isin(numbers) & F.col("term").isin(terms))
        blocks = self.spark.read.schema("block long, n int, ids array<long>").parquet(f"{self.path}/blocks")
        bounds = stored(self._bounds(lists, blocks, need, asked), "bounds")
        hits = reduce(lambda a, b: a + b, [text.keyword_hit(F.col(c), w).cast("int") for w in words for c in fields])
        best: list[tuple[int, int]] = []  # a heap of (hits, -id): the worst first
        wave, after = WAVE, None
        while True:
            ahead = bounds if after is None else bounds.filter(f"bound < {after[0]} or bound = {after[0]} and block > {after[1]}")
            rows = ahead.orderBy(F.desc("bound"), "block").limit(wave).collect()
            rows = [r for r in rows if len(best) < k or r.bound > best[0][0] or r.bound == best[0][0] and r.first_id < -best[0][1]]
            if not rows:
                break
            self._verify(lists, blocks, [r.block for r in rows], need, asked, docs, hits, best, k, id_col)
            after, wave = (rows[-1].bound, rows[-1].block), min(2 * wave, MAX_WAVE)
        return [(-i, round(n / (2 * len(words)), 6)) for n, i in sorted(best, reverse=True)]

    def _bounds(self, lists: DataFrame, blocks: DataFrame, need, asked) -> DataFrame:
        """(block, first_id, bound) of blocks that may hold a hit, by which terms they have. Wildcards alone may be in any text."""
        number = lambda ts, field: F.sum(((F.col("field") == field) & F.col("term").isin(ts)).cast("int")) if ts else F.lit(0)
        sums = [F.when(number(ts, field) == len(ts), n).otherwise(0) for n, ts in need for field in (0, 1)]
        found = lists.groupBy("block").agg(reduce(lambda a, b: a + b, sums).alias("bound"), *[(number(ts, _ATTRIBUTE) > 0).alias(f"a{i}") for i, ts in enumerate(asked)])
        kept = reduce(lambda df, i: df.filter(f"a{i}"), range(len(asked)), found.filter("bound > 0"))
        firsts, anywhere = blocks.select("block", F.element_at("ids", 1).alias("first_id")), 2 * sum(n for n, ts in need if not ts)
        return firsts.join(kept, "block", "left" if anywhere and not asked else "inner").select("block", "first_id", F.coalesce("bound", F.lit(anywhere)).alias("bound"))

    def _verify(self, lists, blocks, numbers, need, asked, docs, hits, best, k, id_col) -> None:
        """Put the documents of these blocks that are among the k best so far into best."""
        here = F.col("block").isin(numbers)
        rows = lists.filter(here).select("block", "term", "field", "places", F.lit(None).cast("array<long>").alias("ids"))
        rows = rows.unionByName(blocks.filter(here).select("block", F.lit(None).cast("long").alias("term"), F.lit(None).cast("byte").alias("field"), F.lit(None).cast("array<short>").alias("places"), "ids"))
        ranked = stored(rows.groupBy("block").applyInArrow(_ranked_block(need, asked), "id long, bound long"), "ranked")
        batch, after = BATCH * k, None
        while True:
            left = ranked if after is None else ranked.filter(f"bound < {after[0]} or bound = {after[0]} and id > {after[1]}")
            if len(best) == k:
                left = left.filter(f"bound > {best[0][0]} or bound = {best[0][0]} and id < {-best[0][1]}")
            few = left.orderBy(F.desc("bound"), "id").limit(batch)
            few = few.collect() if batch <= LITERALS else stored(few, "batch")
            last = (few[-1] if few else None) if batch <= LITERALS else few.orderBy("bound", F.desc("id")).first()
            if last is None:
                return
            near = docs.filter(F.col(id_col).isin([r.id for r in few])) if batch <= LITERALS else docs.join(few.select(F.col("id").alias(id_col)), id_col, "left_semi")
            for r in near.select(F.col(id_col).alias("id"), hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "id").limit(k).collect():
                heapq.heappush(best, (r.hits, -r.id)) if len(best) < k else heapq.heappushpop(best, (r.hits, -r.id))
            after, batch = (last.bound, last.id), 4 * batch

"""Keyword search for a table of queries at once.

Queries are dealt into chunks of bounded size; each chunk meets all contexts in one scan. A task finds the chunk's words in a block of texts,
adds rows of hits by query, and keeps the k best of each query in a heap of its own, so what leaves it is bounded by chunk and k whatever it
read; there are as many tasks as cores, so heaps grow with the queries alone. Heaps are merged by query. BM25, feedback, access and masks then work on pools of k rows by query.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources.shared import new_folder, small_batches, stored
from . import access
from .retrieval import OVER_RETRIEVE, searchable

#: Queries that meet the contexts in one scan, about; texts and queries whose hits are summed together; texts that are read for words together;
#: words that have a row of hits for all texts of a block; pairs of a query and a text with another word that are summed together, about.
CHUNK, ROWS, SLAB, TEXTS, COMMON, PAIRS = 80_000, 32_768, 64, 1024, 2048, 1_000_000
#: Words of so many characters, all among the commonest ones, are found by tables; texts of a block that raise a query's floor first; texts whose
#: largest sum is looked at before each of them; a word that fewer than one text in so many has gets no row.
SHORT, LETTERS, FIRST, FOLD, RARE = 3, 128, 1024, 16, 256


class Words:
    """Which of many words a text holds; _ stands for any character (H04). Short words, which most texts have many of, are looked up in tables."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.n, self.automaton, self.patterns = len(words), ahocorasick.Automaton(), []
        often = Counter(c for w in words if len(w) <= SHORT and "_" not in w for c in w)
        letters = {c: i for i, (c, _) in enumerate(often.most_common(LETTERS), 1)}
        self.letter, self.base = np.zeros(0x110000, np.uint8), len(letters) + 1
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.tables = [np.full(self.base**size, -1, np.int32) for size in range(1, SHORT + 1)]
        short = []
        for i, w in enumerate(words):
            if "_" in w:
                self.patterns.append((i, re.compile(".".join(map(re.escape, w.split("_"))), re.DOTALL)))
            elif 0 < len(w) <= SHORT and all(c in letters for c in w):
                self.tables[len(w) - 1][reduce(lambda code, c: code * self.base + letters[c], w, 0)] = len(short)
                short.append(i)
            else:
                self.automaton.add_word(w, i)
        self.short = np.array(short, np.int32)
        self.automaton.make_automaton()

    def found(self, body: str) -> list[int]:
        return self.found_in([body])[0].tolist()

    def found_in(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, place of its text), each pair once."""
        found, ends = [], [0]
        for body in bodies:
            found += {i for _, i in self.automaton.iter(body)} if len(self.automaton) else ()
            found += [i for i, p in self.patterns if p.search(body)]
            ends.append(len(found))
        word, place = self._short(bodies)
        return np.append(self.short[word], np.array(found, np.int32)), np.append(place, np.repeat(np.arange(len(bodies)), np.diff(ends).astype(int))).astype(np.int32)

    def _short(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros((len(self.short), len(bodies)), bool)
        if held.size:
            place = np.repeat(np.arange(len(bodies)), [len(body) + 1 for body in bodies])
            letters = self.letter[np.frombuffer("\0".join([*bodies, ""]).encode("utf-32-le"), "<u4")].astype(np.int32)  # no word has the separator
            code = np.zeros(len(letters), np.int32)
            for size, table in enumerate(self.tables):
                code = code[: len(letters) - size] * self.base + letters[size:]
                word = table[code]
                at = np.flatnonzero(word >= 0)
                held[word[at], place[at]] = True
        return np.nonzero(held)


class Heaps:
    """The k best (hits, id) of each query so far: more hits first, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.hits, self.ids = k, np.zeros((n, k), np.int32), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, start: int, sums: np.ndarray, ids: np.ndarray) -> None:
        """sums: hits of queries from start by place; ids ascend. Where most have no floor yet, a few places come first and raise it for all others."""
        a, b = 0, FIRST if np.median(self.hits[start : start + len(sums), -1]) == 0 else len(ids)
        while a < len(ids):
            self._add(start, sums[:, a:b], ids[a:b])
            a, b = b, b * 4

    def _add(self, start: int, sums: np.ndarray, ids: np.ndarray) -> None:
        """Only what beats a query's last is sorted."""
        worst, worst_id = self.hits[start : start + len(sums), -1], self.ids[start : start + len(sums), -1]
        floor = np.maximum(np.where(worst_id < ids[0], worst + 1, worst), 1)  # with as many hits a larger id is not better
        row, at = _places(sums, np.minimum(floor, np.iinfo(sums.dtype).max).astype(sums.dtype))
        if len(row) > 3 * self.k * len(sums) and len(ids) <= FIRST:  # many: the k best of these rows first
            key = sums.astype(np.int32) * len(ids) + np.arange(len(ids) - 1, -1, -1, dtype=np.int32)
            top = np.argpartition(-key, min(self.k, len(ids)) - 1, axis=1)[:, : self.k]
            row, at = np.repeat(np.arange(len(sums)), top.shape[1]), top.ravel()
        hits, found = sums[row, at].astype(np.int32), ids[at]
        better = (hits > worst[row]) | (hits == worst[row]) & (found < worst_id[row])
        better &= hits > 0
        row, hits, found = row[better], hits[better], found[better]
        if not len(row):
            return
        mine = np.unique(row)
        queries = np.concatenate([np.repeat(mine, self.k), row])
        hits, found = np.concatenate([self.hits[start + mine].ravel(), hits]), np.concatenate([self.ids[start + mine].ravel(), found])
        order = np.lexsort((found, -hits, queries))
        firsts = np.searchsorted(queries[order], mine)
        kept = order[firsts[:, None] + np.arange(self.k)]  # each has k at least
        self.hits[start + mine], self.ids[start + mine] = hits[kept], found[kept]


def _places(sums: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the sums that reach their row's floor, as few do."""
    n = sums.shape[1] // FOLD
    folded = sums[:, : n * FOLD].reshape(len(sums), FOLD, n)
    row, at = np.divmod(np.flatnonzero(folded.max(axis=1) >= floor[:, None]), max(n, 1))
    which, part = np.nonzero(folded[row, :, at] >= floor[row][:, None])
    rest_row, rest = np.nonzero(sums[:, n * FOLD :] >= floor[:, None])
    return np.append(row[which], rest_row), np.append(part * n + at[which], rest + n * FOLD)


class Asked:
    """How often queries have words. Neighbouring queries whose first words are the same share their sum."""

    def __init__(self, members: list[np.ndarray], n_words: int):
        self.n, self.n_words = len(members), n_words
        query, word = np.repeat(np.arange(self.n), [len(m) for m in members]), np.concatenate(members)
        pairs, self.times = np.unique(query * n_words + word, return_counts=True)
        self.query, self.word = pairs // n_words, pairs % n_words
        self.most = int(np.bincount(query, minlength=1).max())

    def sums(self, word: np.ndarray, at: np.ndarray, hits: np.ndarray, n: int):
        """(first query, hits of SLAB queries by place) of n texts with so many hits of a word; the table is used again. A word that many of the
        texts have is a row of hits, and rows are added; texts of all other words are added one by one."""
        number = np.bincount(word, minlength=self.n_words)
        common = np.argsort(-number, kind="stable")[:COMMON]
        common = common[number[common] > n // RARE]
        place = np.full(self.n_words, -1)
        place[common] = np.arange(len(common))
        kind = np.min_scalar_type(self.most * 2 * int(hits.max(initial=0)) + 1)
        dense = place[word] >= 0
        rows = np.zeros((len(common), n), kind)
        np.add.at(rows.reshape(-1), place[word[dense]] * n + at[dense], hits[dense].astype(kind))
        rows = [*rows]
        word, at, hits = word[~dense], at[~dense], hits[~dense].astype(kind)
        order = np.argsort(word, kind="stable")
        at, hits, number = at[order].astype(np.int64), hits[order], np.bincount(word, minlength=self.n_words)
        starts = np.cumsum(number) - number
        row, few = place[self.word], np.flatnonzero(number[self.word])
        table, spare = np.zeros((SLAB, n), kind), np.zeros((self.most, n), kind)
        for start in range(0, self.n, SLAB):
            out = table[: self.n - start]
            a, b = np.searchsorted(self.query, [start, start + SLAB])
            mine = np.flatnonzero(row[a:b] >= 0) + a
            steps = np.repeat(row[mine], self.times[mine]).tolist()
            ends = np.cumsum(np.bincount(self.query[mine] - start, self.times[mine], len(out))).astype(int).tolist()
            self._added(rows, steps, ends, out, spare)
            mine = few[slice(*np.searchsorted(few, [a, b]))]
            sizes = number[self.word[mine]]
            for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1):
                asked, size = mine[part], sizes[part]
                pair = np.repeat(starts[self.word[asked]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                where = at[pair]
                where += np.repeat((self.query[asked] - start) * n, size)
                np.add.at(out.reshape(-1), where, hits[pair] if self.times[asked].max(initial=1) == 1 else hits[pair] * np.repeat(self.times[asked], size).astype(kind))
            yield start, out

    @staticmethod
    def _added(rows: list[np.ndarray], steps: list[int], ends: list[int], out: np.ndarray, spare: np.ndarray) -> None:
        """Each query's rows (steps, up to its end) added into its row of out; path has the sums of the query before by step."""
        before, path, start = [], [], 0
        for mine, end in zip(out, ends, strict=True):
            asked, same = steps[start:end], 0
            while same < len(before) and same < len(asked) and before[same] == asked[same]:
                same += 1
            del path[same:]
            for r in asked[same:]:
                if path:
                    path.append(np.add(path[-1], rows[r], mine if len(path) == len(asked) - 1 else spare[len(path)]))
                else:
                    path.append(rows[r])
            if not asked:
                mine.fill(0)
            elif same == len(asked) or len(asked) == 1:
                mine[:] = path[-1]
            before, start = asked, end


def _ordered(members: np.ndarray, lengths: np.ndarray, words: list[str]):
    """(order of queries, their words by number, words): words that many queries have come first, and queries with the same first words are neighbours."""
    by_number = np.argsort(-np.bincount(members, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int64)
    place[by_number] = np.arange(len(words))
    lists = [np.sort(m) for m in np.split(place[members], np.cumsum(lengths)[:-1])]
    order = sorted(range(len(lists)), key=lambda q: lists[q].tolist())
    return np.array(order), [lists[q] for q in order], [words[w] for w in by_number]


def _heaps(batches, chunk, k: int):
    queries, members, lengths, words = chunk.value
    order, members, words = _ordered(members, lengths, words)
    queries, finder, best, asked = queries[order], Words(words), Heaps(len(queries), k), Asked(members, len(words))

    def merge(rows: pa.Table) -> None:
        rows = rows.sort_by("id")
        ids, found, places = rows.column("id").to_numpy(), [], []
        for start in range(0, len(ids), TEXTS):
            part = rows.slice(start, TEXTS)
            for name in ("f0", "f1"):
                word, place = finder.found_in(part.column(name).to_pylist())
                found.append(word)
                places.append(place + np.int32(start))
        word, place = np.concatenate(found), np.concatenate(places)
        for start, sums in asked.sums(word, place, np.ones(len(word), np.uint8), len(ids)):
            best.add(start, sums, ids)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            merge(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        merge(pa.Table.from_batches(held))
    query, place = np.nonzero(best.hits > 0)
    yield pa.RecordBatch.from_arrays([pa.array(queries[query]), pa.array(best.ids[query, place]), pa.array(best.hits[query, place])], names=["query_id", "id", "hits"])


def candidates(contexts: DataFrame, queries: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """I03, F02 for each row of queries (query_id long, query): query_id, words, id, score, place of its k best contexts; ties by id.

    Queries without words find nothing. query_ids are unique. The driver holds one chunk of queries.
    """
    spark = contexts.sparkSession
    small_batches(spark)
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), text.tokens(F.col("query")).alias("words")).filter(F.size("words") > 0), "queries")
    chunks = -(-asked.count() // chunk)
    fields = stored(contexts.select(F.col("id").cast("long").alias("id"), *[F.lower(F.coalesce(c, F.lit(""))).alias(f"f{i}") for i, c in enumerate(("l0_content", "l1_content"))]), "fields")
    path, schema = new_folder(spark, "heaps"), "query_id long, id long, hits int"
    spark.createDataFrame([], schema).write.parquet(path)
    for c in range(chunks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c).toArrow().combine_chunks()
        if len(rows):
            words = rows.column("words").combine_chunks()
            encoded = words.flatten().dictionary_encode()
            held = spark.sparkContext.broadcast((rows.column("query_id").to_numpy(), encoded.indices.to_numpy().astype(np.int64), words.value_lengths().to_numpy(), encoded.dictionary.to_pylist()))
            fields.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(lambda it, held=held: _heaps(it, held, k), schema).write.mode("append").parquet(path)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("hits"), "id")
    merged = spark.read.schema(schema).parquet(path).withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= k)
    return merged.join(asked, "query_id").select("query_id", "words", "id", F.round(F.col("hits") / (2 * F.size("words")), 6).alias("score"), "place")


def bm25(pool: DataFrame) -> DataFrame:
    """I04 within each query's pool (query_id, words, place, l0_content, l1_content): rerank_score and new places."""
    body = text.tokens(F.coalesce("l1_content", "l0_content", F.lit("")))
    rows = pool.withColumns({"__t": body}).withColumns({"__n": F.size("__t"), "__tf": F.transform("words", lambda w: F.size("__t") - F.size(F.array_remove("__t", w)))}).drop("__t")
    whole = Window.partitionBy("query_id")
    rows = rows.withColumns({"__mean": F.avg("__n").over(whole), "__docs": F.count("*").over(whole), "__all": F.collect_list("__tf").over(whole)})  # k lists
    df = lambda i: F.size(F.filter("__all", lambda tf: F.get(tf, i) > 0))
    term = lambda tf, i: scores.bm25_term(tf, F.col("__n"), F.col("__mean"), F.col("__docs"), df(i))
    scored = rows.withColumn("rerank_score", F.round(F.aggregate(F.transform("__tf", term), F.lit(0.0), lambda s, x: s + x), 6))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")
    return scored.withColumn("place", F.row_number().over(by_score)).select(*pool.columns, "rerank_score")


def searched(contexts: DataFrame, queries: DataFrame, policies: DataFrame, teams: DataFrame, counters: DataFrame, agent: str, top_k: int = 10, chunk: int = CHUNK) -> DataFrame:
    """The keyword pipeline (I03-I13) for each query: query_id, place, id, uri, final_score, l0_content, l1_content; masks applied."""
    live = searchable(contexts)
    found = candidates(live, queries, top_k * OVER_RETRIEVE, chunk)
    columns = ["id", "uri", "scope", "owner_space", "status", "l0_content", "l1_content"]
    pool = stored(bm25(found.join(live.select(*columns), "id")).join(counters.select("id", "adopted", "ignored"), "id", "left"), "pools")
    final = F.round(F.col("rerank_score") * scores.quality_factor(F.col("adopted"), F.col("ignored")) * scores.stale_factor(F.col("status")), 6)
    seen = access.readable(pool.withColumn("final_score", final), policies, teams, agent)
    by_final = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "place")
    kept = seen.withColumn("place", F.row_number().over(by_final)).filter(F.col("place") <= top_k)
    shown = [text.masked(F.col(c), F.col("field_masks")).alias(c) for c in ("l0_content", "l1_content")]
    return kept.select("query_id", "place", "id", "uri", "final_score", *shown)


def _two_places(score: Column) -> Column:
    """A score of six places with two, halves up."""
    cents = F.floor((F.round(score * 1_000_000).cast("long") + 5000) / 10_000).cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def recall_blocks(results: DataFrame, rooms: DataFrame, header: str, intro: str) -> DataFrame:
    """O02 for each query: query_id, block within its room (rooms: query_id, room in tokens). Results without text, or whose text is a uri only, are left out.

    A block that is too long is cut before the last space that leaves three characters for an ellipsis. Without room for the header and a little
    more there is none.
    """
    body = F.trim(F.regexp_replace(F.coalesce(F.nullif("l1_content", F.lit("")), "l0_content", F.lit("")), r"(?U)\s+", " "))
    only_uri = F.col("body").rlike(r"^(ctx|mem|skill|http|https)://[^ ]*$")
    lines = results.withColumn("body", body).filter((F.col("body") != "") & ~only_uri)
    line = F.concat(F.lit("- **Source**: `"), "uri", F.lit("` (score: "), _two_places(F.col("final_score")), F.lit(")\n  "), "body")
    joined = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("lines"))
    whole, most = F.concat(F.lit(f"{header}\n{intro}\n\n"), "lines"), F.col("room") * 4
    cut = F.substring(F.col("whole"), F.lit(1), most - 3)
    cut = F.regexp_replace(F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r"(?s) [^ ]*\z", "")).otherwise(cut), r"[ \n,;:]+\z", "")
    fitted = F.when(F.length("whole") <= most, F.col("whole")).when(F.length(cut) > len(header) + 8, F.concat(cut, F.lit("...")))
    rows = joined.join(rooms, "query_id").withColumn("whole", whole)
    return rows.select("query_id", F.when(most > len(header) + 8, fitted).alias("block")).filter("block is not null")


def assembled(budgets: DataFrame, blocks: DataFrame, guide: str) -> DataFrame:
    """conv_id, tokens of messages, guide and recalled block, and the text that is added to the prompt; budgets: conv_id, tokens, room."""
    rows = budgets.join(blocks.withColumnRenamed("query_id", "conv_id"), "conv_id", "left")
    return rows.select("conv_id", (F.col("tokens") + F.ceil(F.length(F.coalesce("block", F.lit(""))) / 4)).alias("tokens"), F.concat_ws("\n\n", F.lit(guide), "block").alias("addition"))

"""Operator 13: alignment of two tokenizers over the same bytes.

A group of texts is encoded by both tokenizers and laid out as one run of bytes. One bincount for each tokenizer marks where tokens
end; where both end is a cut. Prefix sums over the marks, read at the texts' bounds, give each text's counts, so no text is walked by itself.

A link joins the two tokens that end at a cut. How often a pair of ids is linked in the corpus is an aggregate over one row for each
group and distinct pair, and it comes back to the group, not to each link: texts hold links as places in their group's list of
pairs. A hot pair has one row for each group, so no key holds more than its share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import _ODD, _SINGLE, ChunkEncoder, JsonTokenizer, _Pool, byte_letters, joined
from .common import small_batches, table, written
from .token_store import tokenizer_path

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that are aligned together (more where one Arrow batch has more); a worker's memory is bounded by some 60 times as much.
GROUP_BYTES = 3 << 20
_TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links array<int>"
_PAIRS = "place int, a int, b int, n long"


class PrefixedEncoder(ChunkEncoder):
    """Ids of texts with a space before each: every chunk between spaces then stands after one."""

    def __init__(self, exact, words):
        super().__init__(True, exact, words)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        pool, cut = _Pool(), pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        run = self._after(pool, coded.dictionary)[coded.indices.to_numpy()]
        odd = np.flatnonzero(np.logical_or.reduceat(run == _ODD, ends[:-1])).tolist()
        if odd:
            pieces = [_SINGLE.split(" " + texts[i].as_py()) for i in odd]
            found, parts = self._texts(pool, [x for p in pieces for x in p]), np.split(run, ends[1:-1])
            for i, p in zip(odd, np.split(found, np.cumsum([len(p) for p in pieces])[:-1]), strict=True):
                parts[i] = p
            run, ends = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        flat, sizes = pool.gather(run)
        return flat, np.append(0, np.cumsum(sizes))[ends]


class Strings:
    """Byte strings by number."""

    def __init__(self, items: list[bytes]):
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(items), np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        kind = np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64
        at = np.repeat((self.begin[ids] - (ends - sizes)).astype(kind), sizes)
        at += np.arange(len(at), dtype=kind)
        return self.flat[at]


def _json_tokens(path: str) -> tuple[ChunkEncoder, list[bytes]]:
    tokenizer = JsonTokenizer(path)
    tokenizer.whole.encode_special_tokens = True  # their strings in a text are plain text
    byte_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    entries = sorted((i, t) for t, i in tokenizer.whole.get_vocab(with_added_tokens=True).items())
    special = tokenizer.whole.get_added_tokens_decoder()
    return PrefixedEncoder(tokenizer.exact, tokenizer.words), [t.encode() if i in special else b"".join(map(byte_of.__getitem__, t)) for i, t in entries]


def _piece_tokens(path: str) -> tuple[ChunkEncoder, list[bytes]]:
    """A sentencepiece model that adds a space before a text. Here the space is in the string, so a copy of the model adds none."""
    import regex
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if any(regex.search(r"[^▁]▁|\n|\p{L}[^\p{L}▁]", p.piece) for p in proto.pieces if p.type == p.NORMAL):
        raise ValueError("pieces reach over the bounds of words")
    proto.normalizer_spec.add_dummy_prefix = False
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(strings: list[str]):
        return joined(model.encode(strings, num_threads=1) if strings else [])

    names = [(p.piece, p.type == p.BYTE) for p in proto.pieces]
    return PrefixedEncoder(encode, encode), [bytes([int(n[3:-1], 16)]) if is_byte else n.replace("▁", " ").encode() for n, is_byte in names]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        loaded = [(_piece_tokens if p.endswith(".model") else _json_tokens)(tokenizer_path(p)) for p in (path_a, path_b)]
        (self.encoder_a, a), (self.encoder_b, b) = loaded
        self.bytes_a, self.bytes_b, self.first_b = Strings(a), Strings(b), 2 * len(a)
        if not (self.bytes_a.size.all() and self.bytes_b.size.all()):
            raise ValueError("a token has no bytes")
        self.labels = Strings([b"%d%c" % (i, s) for n, after in ((len(a), b",|"), (len(b), b",;")) for i in range(n) for s in after])

    def align(self, texts: pa.Array, with_groups: bool = False) -> dict:
        """Counts and digests of texts, and ids of A and B of all links, one text after the other."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        whole = pc.binary_join_element_wise(space, texts, nothing)
        ends_t = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, 8 * whole.offset)
        raw = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[ends_t[0] : ends_t[-1]]
        ends_t = ends_t - ends_t[0]
        sides = [(*e.encode_batch(texts), s) for e, s in ((self.encoder_a, self.bytes_a), (self.encoder_b, self.bytes_b))]
        good = np.diff(ends_t) > 1
        for ids, ends, strings in sides:
            good &= np.diff(np.append(0, np.cumsum(strings.size[ids]))[ends]) == np.diff(ends_t)
        for ids, ends, strings in sides:
            want, bounds = _only(raw, ends_t, good)
            wrong = np.append(0, np.cumsum(strings.gather(_only(ids, ends, good)[0]) != want))
            good &= np.diff(wrong[bounds]) == 0
        (a, ends_a), (b, ends_b), bounds = _only(*sides[0][:2], good), _only(*sides[1][:2], good), _only(raw, ends_t, good)[1]
        at_a, at_b, n = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b]), int(bounds[-1]) + 1
        cut = np.bincount(at_a, minlength=n).astype(bool) & np.bincount(at_b, minlength=n).astype(bool)
        cuts = np.cumsum(cut, dtype=np.int64)
        last_a, last_b = cut[at_a], cut[at_b]
        in_a, in_b = cuts[at_a] - last_a, cuts[at_b] - last_b  # cuts before each token: its group
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(in_b, in_a, "left")] = 2 * a.astype(np.int64) + last_a
        code[np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")] = self.first_b + 2 * b.astype(np.int64) + last_b
        written_ends = np.append(0, np.cumsum(self.labels.size[code]))[ends_a + ends_b].tolist()
        chars = self.labels.gather(code).tobytes()
        groups = [chars[x : max(x, y - 1)] for x, y in zip(written_ends[:-1], written_ends[1:], strict=True)]
        per_text = np.diff(cuts[bounds])
        return {
            "n_a": np.diff(ends_a), "n_b": np.diff(ends_b), "n_groups": per_text, "n_links": per_text, "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups],
            "groups": [g.decode() for g in groups] if with_groups else [None] * len(groups), "a": a[last_a], "b": b[last_b],
        }


def _only(values: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of good texts, and ends of all texts: others are empty."""
    sizes = np.diff(ends)
    return values[np.repeat(good, sizes)], np.append(0, np.cumsum(np.where(good, sizes, 0)))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _fields(*schemas: str) -> list[list[str]]:
    return [f.split() for s in schemas for f in s.split(", ")]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.large_string(), "array<int>": pa.list_(pa.int32())}


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    fields = [["part", "long"], *_fields(_TEXTS, _PAIRS)]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _ARROW[t]) if c in columns else pa.nulls(n, _ARROW[t]) for c, t in fields], names=[c for c, _ in fields])


def _align(batches, path_a: str, path_b: str, with_groups: bool, group_bytes: int):
    both, part, held, size = aligner(path_a, path_b), TaskContext.get().partitionId() << 33, [], 0

    def out():
        nonlocal held, size, part
        rows = pa.Table.from_batches(held).combine_chunks()
        found = both.align(rows.column("text").chunk(0) if rows.num_rows else pa.array([], pa.large_string()), with_groups)
        a, b = found.pop("a").astype(np.int64), found.pop("b").astype(np.int64)
        pairs, place, n = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
        links = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found["n_links"])), pa.int32()), pa.array(place, pa.int32()))
        yield _batch(found | {"part": np.full(rows.num_rows, part), "doc_id": rows.column("doc_id").combine_chunks(), "links": links}, rows.num_rows)
        yield _batch({"part": np.full(len(n), part), "place": np.arange(len(n)), "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "n": n}, len(n))
        held, size, part = [], 0, part + 1

    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= group_bytes:
            yield from out()
    if held:
        yield from out()


def _looked_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of one group's texts."""
    links = texts.column("links").combine_chunks()
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, bool)
    place = pairs.column("place").to_numpy()
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    at, ends = links.flatten().to_numpy(), np.append(0, np.cumsum(texts.column("n_links").to_numpy()))
    sums = [pa.array(np.diff(np.append(0, np.cumsum(v[at], dtype=np.int64))[ends])) for v in (best, count)]
    kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"])
    return kept.append_column("n_best", sums[0]).append_column("count_sum", sums[1])


def align_documents(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with_groups, the groups as text.

    A text has no tokens where it is null or empty, or where the bytes of its tokens, by either tokenizer, are not a space and the
    text (U+2581, which sentencepiece reads as a space): zeros, and '' for the digest. Null and repeated doc_ids are texts like any
    other; an empty table gives no rows; other columns are not read. Ties for a B id's highest count are all best.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = written(rows.mapInArrow(lambda it: _align(it, a, b, with_groups, group_bytes), f"part long, {_TEXTS}, {_PAIRS}"), "alignment", compression="zstd")
    pairs = made.filter("place IS NOT NULL").select("part", *[c for c, _ in _fields(_PAIRS)])
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    judged = counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    known = pairs.join(judged, ["a", "b"]).select(F.col("part").alias("of_part"), "place", "count", "best")
    texts = made.filter("place IS NULL").select("part", *[c for c, _ in _fields(_TEXTS)])
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    found = texts.groupBy("part").cogroup(known.groupBy("of_part")).applyInArrow(_looked_up, schema)
    return found if with_groups else found.drop("groups")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))

"""Operator 10: byte-level BPE encoding and decoding by a sentencepiece model that is serialised from the ranks.

Every vocabulary entry becomes a sentencepiece piece: its bytes mapped one to one to printable characters, its score the
negative rank, so that sentencepiece merges the pair of lowest rank first. Normalisation is the identity. Pre-tokens are
matched by the vocabulary's pattern and encoded one by one; a pre-token that is itself an entry is that entry's id.
Decoding looks up each id's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, byte_letters, joined
from .common import small_batches, table
from .token_store import tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
_codecs: dict[str, "BpeCodec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model (protocol buffer): pieces in rank order, an unknown piece after them, BPE, identity rules.

    Field numbers are those of sentencepiece's published model schema.
    """
    letters = byte_letters()
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(letters[b] for b in token).encode()
        pieces.append(_message(1, _message(1, name) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1)))
    pieces.append(_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(ranks))
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normalizer)


class BpeCodec:
    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0, 1, 2 ... without gaps")
        self.ranks, self.letters = ranks, dict(enumerate(byte_letters()))
        self.bytes_of = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.chunks = ChunkEncoder(True, self._exact, self._words)

    def _tokens(self, tokens: list[bytes]) -> list:
        """Ids of pre-tokens: one that has a rank is that id, others are merged by the model."""
        merged = [t for t in tokens if t not in self.ranks]
        mapped = [t.decode("latin-1").translate(self.letters) for t in merged]
        found = iter(self.model.encode(mapped, num_threads=1)) if mapped else iter(())
        return [[self.ranks[t]] if t in self.ranks else next(found) for t in tokens]

    def _words(self, strings: list[str]):
        return joined(self._tokens([s.encode() for s in strings]))

    def _exact(self, strings: list[str]):
        found = [[m.encode() for m in self.pattern.findall(s)] for s in strings]
        tokens = list({t for f in found for t in f})
        ids = dict(zip(tokens, self._tokens(tokens), strict=True))
        return joined([[i for t in f for i in ids[t]] for f in found])

    def encode(self, text: str | None) -> bytes:
        """Little-endian uint32 ids of a text; none for null or empty text."""
        return self.chunks.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def codec(path: str) -> BpeCodec:
    """One for each worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(tokenizer_path(path))
    return _codecs[path]


def _ids(batches, path: str):
    for batch, flat, ends in codec(path).chunks.encode_batches(batches):
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype("<i4")), pa.py_buffer(flat.astype("<u4", copy=False))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends)), ids], names=["doc_id", "n_tokens", "ids"])


def encode_documents(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32). Null and empty texts have no ids; repeated rows are encoded each,
    an empty table gives no rows; other columns are not read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _ids(it, path), "doc_id long, n_tokens long, ids binary")


def _digests(batches, path: str):
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(codec(path).decode(x)).hexdigest() for x in ids], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    return encoded.mapInArrow(lambda it: _digests(it, RANKS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

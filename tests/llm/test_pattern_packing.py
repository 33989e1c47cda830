"""Operator 12: exact pieces, no overlap, and few sequences."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import DOCS, ODD, documents, empty, odd  # noqa: F401

from tessera.llm import pattern_packing as pp


def lengths_of(kind, n, rng):
    if kind == "mixed":
        return np.clip(rng.lognormal(6.3, 0.8, n).astype(int), 1, 2048)
    if kind == "half empty":
        return np.where(np.arange(n) % 2, 1, lengths_of("mixed", n, rng))
    return rng.integers(1, 2049, n) if kind == "even" else np.full(n, 700)


@pytest.mark.parametrize(("kind", "n", "over"), [("mixed", 5000, 0.003), ("half empty", 5000, 0.003), ("even", 3000, 0.02), ("one length", 500, None), ("mixed", 7, 0.5)])
def test_slots(kind, n, over):
    """Each piece has a place of its own within the capacity, and sequences are few."""
    lengths = lengths_of(kind, n, np.random.default_rng(2))
    slots = pp.plan_slots(np.bincount(lengths, minlength=2049))
    seen, spans = Counter(), defaultdict(list)
    for length in lengths.tolist():
        rank, seen[length] = seen[length], seen[length] + 1
        (i,) = [i for i in np.flatnonzero(slots["length"] == length) if slots["first"][i] <= rank][-1:]
        j, repeats = rank - slots["first"][i], slots["repeats"][i]
        spans[int(slots["sequence"][i] + j % repeats)].append((int(slots["offset"][i] + j // repeats * length), length))
    assert sorted(spans) == list(range(len(spans)))
    for parts in spans.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) <= 2048
    least = 250 if kind == "one length" else -(-int(lengths.sum()) // 2048)
    assert len(spans) <= least * (1 + (over or 0)) + 1


def test_fit_finds_exact_counts():
    """Counts that are a sum of patterns are fitted to nothing left."""
    rows = np.array([[1024, 1024, 0, 0], [1500, 548, 0, 0], [1000, 700, 348, 0], [600, 600, 500, 348]])
    want = np.array([5, 11, 3, 40])
    counts = np.zeros(2049)
    for row, n in zip(rows, want, strict=True):
        np.add.at(counts, row[row > 0], n)
    assert np.abs(pp.fit(rows, counts, 3000) - want).max() < 0.05


def check(rows, docs):
    """rows against ids of an untouched tokenizer; the number of sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(pp.TOKENIZER))
    want, spans, total = Counter(), defaultdict(list), 0
    for doc_id, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) <= 2048
    return len(spans), -(-total // 2048)


def test_packing_query(spark):
    n, least = check(pp.op12_pattern_packing(spark, "/root/testdata/sf0.001").collect(), [(r.doc_id, r.text) for r in documents(spark).collect()])
    assert n <= least + 2


def test_packing_odd(spark, odd):  # noqa: F811
    rows = pp.pack_patterns(odd).collect()
    check(rows, [(r[0], r[1]) for r in ODD])
    assert all(zlib.crc32(np.array(r.ids, "<i4")) == r.ids_crc32 for r in rows)
    assert pp.pack_patterns(empty(spark, DOCS)).count() == 0
    many = pp.pack_patterns(spark.createDataFrame([(i, None, None, None, None) for i in range(5000)], DOCS), with_ids=False).collect()
    assert check(many, [(i, None) for i in range(5000)])[0] == 3

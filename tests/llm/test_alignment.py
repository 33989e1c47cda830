"""Operator 13 against plain loops over untouched tokenizers."""

import hashlib
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pytest
from test_llm import DOCS, ODD, documents, empty, odd  # noqa: F401

from tessera.llm import alignment
from tessera.llm.chunks import byte_letters

TEXTS = [
    None, "", " ", "  ", "a", "a ", "\n", "\n\n x", "foo\nbar baz\n", "x" * 3000 + " y", "▁a", "a▁", "<|endoftext|> <s> </s> <unk>", "日本語 \U0001f600 é́  \x1c z", "word, (paren) e.g. don't\tX",
    " a b　c", "a\x00b", "ﬁ ½ İstanbul ſ", "  two  spaces\n\n\nand lines ", "word word word, word.", "\r\n a\r\n",
]


@pytest.fixture(scope="module")
def by_hand():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path(alignment.TOKENIZER_A)), sentencepiece.SentencePieceProcessor(model_file=P.path(alignment.TOKENIZER_B))
    a.encode_special_tokens = True
    of, names = {c: i for i, c in enumerate(byte_letters())}, {i: t for t, i in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(of[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (left, right) if all(b"".join(x for _, x in side) == whole for side in (left, right)) else ([], [])

    def one(text):
        left, right = tokens(text)
        ends = [list(accumulate(len(x) for _, x in side)) for side in (left, right)]
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(str(t) for t, _ in left[i:i2]) + "|" + ",".join(str(t) for t, _ in right[j:j2]))
            links.append((left[i2 - 1][0], right[j2 - 1][0]))
            i, j = i2, j2
        return len(left), len(right), ";".join(groups), links

    return one


def test_align(by_hand):
    found = alignment.aligner(alignment.TOKENIZER_A, alignment.TOKENIZER_B).align(pa.array(TEXTS, pa.string()), with_groups=True)
    want = [by_hand(t) for t in TEXTS]
    assert [*zip(found["n_a"].tolist(), found["n_b"].tolist(), found["groups"], strict=True)] == [w[:3] for w in want]
    assert [*zip(found["a"].tolist(), found["b"].tolist(), strict=True)] == [x for w in want for x in w[3]]
    assert sum(not w[2] for w in want) == 4  # null, empty and two with U+2581


def expected(rows, by_hand):
    per = [(i, *by_hand(t)) for i, t in rows]
    counts = Counter(x for p in per for x in p[4])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter((i, n_a, n_b, len(x), len(x), hashlib.sha256(g.encode()).hexdigest() if g else "", sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x)) for i, n_a, n_b, g, x in per)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_alignment_query(spark, by_hand):
    want = expected([(r.doc_id, r.text) for r in documents(spark).collect()], by_hand)
    found = alignment.op13_alignment(spark, "/root/testdata/sf0.001")
    assert Counter(tuple(r[c] for c in NAMES) for r in found.collect()) == want
    small = alignment.align_documents(documents(spark).repartition(3), group_bytes=1)  # a group for each Arrow batch
    assert Counter(tuple(r[c] for c in NAMES) for r in small.collect()) == want


def test_alignment_odd(spark, odd, by_hand):  # noqa: F811
    found = alignment.align_documents(odd, with_groups=True)
    assert found.columns[-3:] == ["groups", "n_best", "count_sum"]
    assert Counter(tuple(r[c] for c in NAMES) for r in found.collect()) == expected([(r[0], r[1]) for r in ODD], by_hand)
    assert alignment.align_documents(empty(spark, DOCS)).count() == 0

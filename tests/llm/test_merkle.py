"""Operator 11 against a tree built by plain loops, and against its SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import harness
import pytest
from test_llm import DOCS, ODD, SF, documents, empty, odd  # noqa: F401

from tessera.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, arity):
    """The root, and for each leaf the (left, right) hashes of each level."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p // arity * arity
            steps[i].append(("".join(level[first:p]), "".join(level[p + 1 : first + arity])))
        level, at = [h(*level[i : i + arity]) for i in range(0, len(level), arity)], [p // arity for p in at]
    return level[0], steps


def expected(rows, arity=2):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in langs}
    root, over = tree([trees[g][0] for g in langs], arity)
    out = Counter()
    for g, above in zip(langs, over, strict=True):
        for (_, _, own, r), steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            steps = steps + above
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            top = leaf((*r[:3], r[3] if r[3] is None else r[3] + 1, r[4])) if bad else own
            for left, right in steps:
                top = h(left, top, right)
            out[r[0], own, trees[g][0], root, h(*[x for s in steps for x in s]), top, top == root] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())


@pytest.mark.parametrize(("block", "arity"), [(256, 2), (4, 2), (9, 3)])
def test_manifest(spark, monkeypatch, block, arity):
    monkeypatch.setattr(merkle, "BLOCK", block)  # small blocks make many tiers
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents(spark).collect()]
    assert got(merkle.manifest(documents(spark), arity)) == expected(rows, arity)


def test_manifest_sql(spark):
    assert harness.difference(merkle.op11_merkle_manifest(spark, SF), harness.duck(SF), merkle.ORACLE_SQL) == ""


def test_manifest_odd(spark, odd):  # noqa: F811
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in ODD]
    assert got(merkle.manifest(odd)) == expected(rows)
    assert merkle.manifest(empty(spark, DOCS)).count() == 0
    alone = got(merkle.manifest(spark.createDataFrame([(7, "x", "en", "a", None)], DOCS)))
    assert alone == expected([(7, "a", "en", None, "x")]) and {(k[1] == k[2] == k[3], k[4]) for k in alone} == {(True, h())}


def test_numbered_spreads_equal_rows(spark):
    """A third of all rows is one row: no part holds them all, and places have no gaps."""
    rows = spark.range(3000).selectExpr("'k' AS g", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS v")
    placed = merkle.numbered(rows, ["g"], ["v"])
    assert sorted(r.idx for r in placed.collect()) == list(range(3000))
    assert {r.size for r in placed.collect()} == {3000}
    by_place = [r.v for r in sorted(placed.collect(), key=lambda r: r.idx)]
    assert by_place == sorted(by_place)

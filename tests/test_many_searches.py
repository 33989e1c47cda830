"""Search for a table of queries against searches one by one."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import text
from tessera.operators import many_searches, retrieval

WORDS = "the schule data base lake a_b tee toe x straße".split()
CONTEXT = "id long, uri string, context_type string, scope string, owner_space string, status string, version int, l0_content string, l1_content string, l2_content string"


def contexts(spark, n=60):
    rng = random.Random(3)
    say = lambda: rng.choice([None, " ".join(rng.choices(WORDS, k=5))])
    rows = [(i, f"ctx://datalake/d{i}", "resource", "datalake", None, "archived" if i % 9 == 0 else "stale" if i % 4 == 0 else "active", 1, say(), say(), None) for i in range(n)]
    rows += [(1000 + i, f"ctx://datalake/c{i}", "resource", "datalake", None, "active", 1, "the data", "data base of the lake", None) for i in range(n // 2)]
    return spark.createDataFrame(rows, CONTEXT)


ASKED = [(1, "the data"), (2, "t_e t_e School"), (3, None), (4, ""), (5, "zzz"), (6, "STRASSE straße x"), (7, "lake lake base"), (8, "?!")]


def test_candidates(spark):
    rows, queries = contexts(spark), spark.createDataFrame(ASKED, "query_id long, query string")
    live = retrieval.searchable(rows)
    got = {}
    for r in many_searches.candidates(live, queries, 7, chunk=2).collect():
        got.setdefault(r.query_id, {})[r.place] = (r.id, r.score)
    want = {i: {r.place: (r.id, r.score) for r in retrieval.keyword_candidates(live, q or "", 7).collect()} for i, q in ASKED}
    assert got == {i: w for i, w in want.items() if w} and {len(w) for w in want.values()} == {0, 7}
    assert many_searches.candidates(live, queries.limit(0), 7).count() == 0
    assert many_searches.candidates(live.limit(0), queries, 7).count() == 0


def test_hits_of_few_and_many(monkeypatch):
    """Dense, listed and split sums, and heaps that keep the best whatever the order, are those of a loop; most sums are never sorted."""
    monkeypatch.setattr(many_searches, "SLAB", 7)
    monkeypatch.setattr(many_searches, "COMMON", 3)
    monkeypatch.setattr(many_searches, "PAIRS", 20)
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 12, rng.integers(1, 6)) for _ in range(30)]
    asked, best, want = many_searches.Asked(members, 12), many_searches.Heaps(30, 4), [[] for _ in members]
    ids = rng.permutation(400)
    for part in np.split(ids, 8):
        part = np.sort(part)
        hits = rng.integers(0, 3, (12, 50)) * (rng.random((12, 50)) < 0.3)
        word, at = np.nonzero(hits)
        for start, sums in asked.sums(word, at, hits[word, at].astype(np.float32), 50):
            assert (sums == np.stack([hits[m].sum(0) for m in members[start : start + 7]])).all()
            best.add(start, sums, part)
        for q, m in enumerate(members):
            want[q] += [(-int(h), int(i)) for h, i in zip(hits[m].sum(0), part, strict=True) if h]
    assert [[(-int(h), int(i)) for h, i in zip(best.hits[q], best.ids[q], strict=True) if h] for q in range(30)] == [sorted(w)[:4] for w in want]


def test_pipeline(spark):
    rows, queries = contexts(spark), spark.createDataFrame(ASKED, "query_id long, query string")
    policies = spark.createDataFrame([(1, "ctx://datalake/c*", "me", "allow", ["read"], ["LAKE"], 5), (2, "ctx://datalake/d2*", "me", "deny", ["read"], None, 0)], "policy_id long, pattern string, principal string, effect string, actions array<string>, field_masks array<string>, priority int")
    teams = spark.createDataFrame([], "path string, direct boolean")
    counters = spark.createDataFrame([(5, 9, 0), (1003, 0, 9)], "id long, adopted long, ignored long")
    got = {}
    columns = ("place", "id", "final_score", "l0_content", "l1_content")
    for r in many_searches.searched(rows, queries, policies, teams, counters, "me", 4, chunk=3).collect():
        got.setdefault(r.query_id, []).append(tuple(r[c] for c in columns))
    for i, q in ASKED:
        want = [tuple(r[c] for c in columns) for r in retrieval.search(rows, q or "", policies, teams, counters, "me", 4).collect()] if text.query_tokens(q) else []
        assert sorted(got.get(i, [])) == sorted(want), q
    assert any("[MASKED]" in (r[4] or "") for r in got[1])


def test_blocks(spark):
    results = spark.createDataFrame([(1, 1, "u", 0.126, "zero", "some  text\nhere"), (1, 2, "v", 1.5, " ", ""), (1, 3, "w", 0.1, "x", "https://a.b/c"), (1, 4, "y", 2.0, "level zero", None), (2, 1, "u", 0.5, "", None), (3, 1, "u", 0.5, "a", "b " * 90), (4, 1, "u", 0.5, "a", "b")], "query_id long, place int, uri string, final_score double, l0_content string, l1_content string")
    rooms = spark.createDataFrame([(1, 1000), (2, 1000), (3, 20), (4, 3)], "query_id long, room int")
    got = {r.query_id: r.block for r in many_searches.recall_blocks(results, rooms, "## Head", "Intro:").collect()}
    assert got[1] == "## Head\nIntro:\n\n- **Source**: `u` (score: 0.13)\n  some text here\n\n- **Source**: `y` (score: 2.00)\n  level zero"
    assert set(got) == {1, 3}  # nothing to tell, and no room for more than a header
    assert len(got[3]) <= 80 and got[3].endswith("b...")
    budgets = spark.createDataFrame([(1, 10, 5), (9, 7, 0)], "conv_id long, tokens long, room long")
    whole = {r.conv_id: (r.tokens, r.addition) for r in many_searches.assembled(budgets, spark.createDataFrame([(1, "12345")], "query_id long, block string"), "guide").collect()}
    assert whole == {1: (12, "guide\n\n12345"), 9: (7, "guide")}


def test_words():
    words = many_searches.Words(["the", "t_e", "he", "_"])
    assert sorted(words.found("the")) == [0, 1, 2, 3] and sorted(words.found("t\ne")) == [1, 3] and words.found("") == []


ALPHABET = "abcdeß日本語ñ𝔘_"


def test_words_of_a_block(monkeypatch):
    """Words from tables (short ones of common letters), from the automaton and with wildcards are those of a loop, each once a text."""
    rng = random.Random(5)
    monkeypatch.setattr(many_searches, "LETTERS", 6)
    some = lambda most: "".join(rng.choices(ALPHABET, k=rng.randint(1, most)))
    words = list(dict.fromkeys(some(6) for _ in range(300)))
    bodies = ["", "\0", "a\0b", *(" ".join(some(9) for _ in range(rng.randint(0, 8))) for _ in range(100))]
    word, place = many_searches.Words(words).found_in(bodies)
    holds = lambda body, w: re.search(".".join(map(re.escape, w.split("_"))), body, re.DOTALL) is not None
    assert sorted(zip(word.tolist(), place.tolist(), strict=True)) == [(i, j) for i, w in enumerate(words) for j, body in enumerate(bodies) if holds(body, w)]
    assert many_searches.Words(["_"]).found_in(["", "x"])[1].tolist() == [1] and many_searches.Words(["abc"]).found_in([])[0].tolist() == []


@pytest.mark.parametrize("many", [3, 300])
def test_heaps_of_blocks(monkeypatch, many):
    """The best of every query over blocks whose ids come in any order, also where hits need more than a byte."""
    for name, value in {"ROWS": 64, "TEXTS": 16, "SLAB": 4, "FIRST": 8, "FOLD": 4, "RARE": 8, "COMMON": 5}.items():
        monkeypatch.setattr(many_searches, name, value)
    rng = random.Random(many)
    words = ["a", "b", "ab", "abc", "cab", "dd", "e", "zzzz"]
    texts = [(i, *("".join(rng.choices("abcde ", k=rng.randint(0, 12))) for _ in range(2))) for i in rng.sample(range(10_000), 500)]
    asked = [rng.choices(words, k=rng.randint(1, 4)) for _ in range(30)] + [["b"] * many]
    number = np.array([words.index(w) for q in asked for w in q])

    class Chunk:
        value = (np.arange(100, 131), number, np.array([len(q) for q in asked]), words)

    rows = pa.table(dict(zip(("id", "f0", "f1"), map(list, zip(*texts, strict=True)), strict=True)))
    got = {}
    for batch in many_searches._heaps(iter(rows.to_batches(10)), Chunk, 6):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"] - 100, set()).add((-r["hits"], r["id"]))
    for q, asks in enumerate(asked):
        want = sorted((-sum((w in f0) + (w in f1) for w in asks), i) for i, f0, f1 in texts)
        assert got.get(q, set()) == {w for w in want[:6] if w[0]}, asks


def test_neighbours_share_sums(monkeypatch):
    """Queries with the same first words add their rows once; before, each query met each word of the block anew."""
    calls, real = [], np.add

    class Counted:
        at = real.at

        def __call__(self, *args):
            calls.append(1)
            return real(*args)

    members = [np.array([*range(8), 8 + i % 4]) for i in range(64)]
    order, members, _ = many_searches._ordered(np.concatenate(members), np.full(64, 9), list("abcdefghijkl"))
    asked = many_searches.Asked(members, 12)
    word, at = np.nonzero(np.ones((12, 32)))
    monkeypatch.setattr(np, "add", Counted())
    sums = np.concatenate([out.copy() for _, out in asked.sums(word, at, np.ones(len(word), np.uint8), 32)])
    assert (sums == 9).all() and len(calls) <= 7 + 4  # 64 x 8 without sharing
    assert sorted(order.tolist()) == list(range(64))


def test_floors_spare_passes(monkeypatch):
    """A block meets heaps without floors in steps, later blocks in one pass, and what does not reach the floor is never sorted."""
    monkeypatch.setattr(many_searches, "FIRST", 8)
    best, passes, sorts, real = many_searches.Heaps(3, 2), [], [], many_searches.Heaps._add
    monkeypatch.setattr(many_searches.Heaps, "_add", lambda self, start, sums, ids: passes.append(len(ids)) or real(self, start, sums, ids))
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys[0])) or lexsort(keys))
    sums = np.tile(np.arange(100, dtype=np.uint8) % 10, (3, 1))
    best.add(0, sums, np.arange(100))
    assert passes == [8, 24, 68] and best.ids.tolist() == [[9, 19]] * 3 and max(sorts) < 50
    del passes[:], sorts[:]
    best.add(0, sums, np.arange(100, 200))
    assert passes == [100] and not sorts


def test_bm25_of_pools(spark):
    """Scores are those of a loop, also of repeated words; no function runs for each pair of a word and a token."""
    docs = {1: "the lake the data", 2: "lake", 3: "straße x x x lake", 4: ""}
    pool = spark.createDataFrame([(7, ["lake", "x", "the", "lake"], i, i, None, body) for i, body in docs.items()], "query_id long, words array<string>, id long, place int, l0_content string, l1_content string")
    out = many_searches.bm25(pool)
    tf = {i: [body.split().count(w) for w in ("lake", "x", "the", "lake")] for i, body in docs.items()}
    mean = sum(len(body.split()) for body in docs.values()) / 4
    df = [sum(t[j] > 0 for t in tf.values()) for j in range(4)]
    term = lambda t, n, d: np.log((4 - d + 0.5) / (d + 0.5) + 1) * t * 2.5 / (t + 1.5 * (0.25 + 0.75 * n / mean))
    want = {i: round(sum(term(t, len(docs[i].split()), d) for t, d in zip(tf[i], df, strict=True) if t), 6) for i in docs}
    assert {r.id: r.rerank_score for r in out.collect()} == want
    assert "array_remove" in out._jdf.queryExecution().optimizedPlan().toString()

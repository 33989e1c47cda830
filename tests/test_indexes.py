"""Indexes against scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import retrieval, text_index, vector_index
from tessera.sources.shared import new_folder


def vectors(spark, n=400, size=16, seed=5):
    """Clusters, copies of one vector (a third of all), and rows without a direction."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((8, size))[rng.integers(0, 8, n)] + 0.4 * rng.standard_normal((n, size))
    x[: n // 3] = x[0]
    odd = [(n, None), (n + 1, [0.0] * size), (n + 2, [float("nan")] * size), (n + 3, [None] * size), (n + 4, [])]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>")


def scan(x, k, ids):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {i: [(int(j), float(np.round(u @ u[i], 6)[j])) for j in np.lexsort((np.arange(len(x)), -np.round(u @ u[i], 6)))[:k]] for i in ids}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    return out


@pytest.fixture(scope="module")
def index(spark):
    x, rows = vectors(spark)
    path = new_folder(spark, "index")
    vector_index.build(rows, path, cells=20)
    return x, rows, vector_index.VectorIndex(spark, path)


def asked(rows):
    return rows.filter("vec_id % 50 = 0 or vec_id > 398").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def test_all_cells_are_a_scan(index):
    x, rows, ix = index
    ids = [i for i in range(400) if i % 50 == 0 or i > 398]
    assert found(ix.search(asked(rows), 30, ix.cells)) == scan(x, 30, ids)
    assert found(ix.search(asked(rows), 1000, ix.cells)) == scan(x, 1000, ids)  # more than there are


def test_probes_reach_recall_and_prune(index):
    x, rows, ix = index
    assert 1 <= ix.probes < ix.cells
    want, got = scan(x, 60, range(0, 400, 50)), found(ix.search(asked(rows), 60))
    assert np.mean([len({v for v, _ in got[i]} & {v for v, _ in want[i]}) / 60 for i in want]) >= 0.9
    one = rows.filter("vec_id = 399").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = ix.search(one, 5, 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") and len({r.cell for r in ix.probed(one, 2).collect()}) == 2


def test_allowed_and_empty(spark, index):
    x, rows, ix = index
    odd = spark.range(400).filter("id % 2 = 1").select(F.col("id").alias("vec_id"))
    got = found(ix.search(asked(rows), 10, ix.cells, odd))
    want = {i: [p for p in near if p[0] % 2][:10] for i, near in scan(x, 400, got).items()}
    assert got == want
    nothing = vector_index.build(rows.filter("vec_id >= 400"), new_folder(spark, "index"))
    assert nothing.search(asked(rows), 5).count() == 0
    assert ix.search(asked(rows).limit(0), 5).count() == 0


def test_codes_bound_cosines(spark):
    """Small blocks and a coarse code still lose nothing, since what the code misses is part of the bounds."""
    x, rows = vectors(spark, 150, 5, 9)
    ix = vector_index.build(rows, new_folder(spark, "index"), cells=4, target=None, block=7)
    assert found(ix.search(asked(rows.filter("vec_id < 150")), 20)) == scan(x, 20, range(0, 150, 50))


def test_far_cells_have_a_floor(spark, monkeypatch):
    """Few rows of the far cells are kept: without a floor each query had k of every cell."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((10, 8))[rng.integers(0, 10, 2000)] + 0.05 * rng.standard_normal((2000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ix, kept, real = vector_index.build(rows, new_folder(spark, "index"), cells=25, target=None), [], vector_index.stored
    monkeypatch.setattr(vector_index, "stored", lambda df, label: kept.append((label, real(df, label))) or kept[-1][1])
    assert found(ix.search(asked(rows).filter("query_id % 50 = 0"), 10)) == scan(x, 10, range(0, 2000, 50))
    bounds = sum(df.count() for label, df in kept if label == "bounds")
    assert 40 * 10 <= bounds <= 40 * 10 * 10


def test_sample_is_bounded(spark):
    """Rows are chosen one by one, without a sort that ends in one task."""
    rows = spark.range(20_000).withColumnRenamed("id", "vec_id")
    chosen = vector_index._sampled(rows, 1000, 20_000)
    assert 850 < chosen.count() < 1150 and vector_index._sampled(rows, 20_000, 20_000).count() == 20_000
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan


def test_folders_are_listed_once(spark, index, monkeypatch):
    """Searches share the listing of an index's folders, and a search whose queries probe every cell has no list of cells in its plan."""
    x, rows, ix = index
    ix, read, reader = vector_index.VectorIndex(spark, ix.path), [], type(spark.read)
    real = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **options: read.append(paths[0]) or real(self, *paths, **options))
    for probes in (ix.cells, ix.cells - 1, 2):
        ix.search(asked(rows), 5, probes).count()
    assert sorted(p for p in read if p.startswith(ix.path)) == [f"{ix.path}/blocks", f"{ix.path}/vectors"]
    every = rows.filter("vec_id < 400").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert " IN (" not in ix.search(every, 5, ix.cells - 1)._jdf.queryExecution().optimizedPlan().toString()


def test_recall_without_a_join(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "query_id long, vec_id long")
    out = vector_index.recall(pairs([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 9)]), pairs([(1, 2), (1, 4), (1, 7), (2, 1), (4, 1)]))
    assert {r.query_id: r.recall for r in out.collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_cells(spark):
    """Cells are fitted without a task for each of them, whose results all end in the driver."""
    units = np.random.default_rng(3).standard_normal((400, 64))
    rows = spark.createDataFrame([(u.tolist(),) for u in units / np.linalg.norm(units, axis=1, keepdims=True)], "unit array<double>").repartition(3)
    context = spark.sparkContext
    context.setJobGroup("cells", "cells")
    try:
        centers = vector_index._fitted(rows, 130)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("cells") for s in tracker.getJobInfo(j).stageIds]
    assert len(centers) == 130 and len(stages) > 10 and max(s.numTasks for s in stages if s) < 20


WORDS = "the schule straße École naïve data base lake a_b tee toe 日本語 x".split()


def texts(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    say = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(WORDS, rng.integers(0, 6)).tolist())
    rows = [(int(i), say(), say(), "even" if i % 2 == 0 else "odd") for i in rng.permutation(n) * 3]
    rows += [(5000 + i, "the same text", None, "odd") for i in range(n // 2)]  # a third are copies
    return spark.createDataFrame(rows, "id long, l0_content string, l1_content string, kind string")


@pytest.fixture(scope="module")
def grams(spark):
    path = new_folder(spark, "docs")
    texts(spark).write.parquet(path)
    docs = spark.read.parquet(path)
    return docs, text_index.build(docs, new_folder(spark, "grams"), attributes={"kind": F.col("kind")}, block=16)


@pytest.mark.parametrize(("query", "k"), [("the data", 1), ("t_e", 40), ("strasse straße école ÉCOLE a", 1000), ("_", 3), ("__ tee tee", 1000), ("日本 本語 the_same x", 40), ("zzz", 5), ("", 5)])
def test_grams_are_a_scan(monkeypatch, grams, query, k):
    monkeypatch.setattr(text_index, "WAVE", 1)
    monkeypatch.setattr(text_index, "LITERALS", 100)  # larger batches are joined
    docs, index = grams
    odd = docs.filter("kind = 'odd'")
    for rows, kinds in ((docs, None), (odd, {"kind": ["odd"]})):
        want = [(r.id, round(r.score, 6)) for r in retrieval.keyword_candidates(rows, query, k).orderBy("place").collect()]
        assert index.search(rows, query, k, kinds) == want


def test_grams_of_keywords():
    assert text_index.grams_of("ab_cdef") == [text_index.term_of(g) for g in ("ab", "cde", "def")]
    assert text_index.grams_of("__") == [] and len(text_index.grams_of("aaaa")) == 1
    assert max(map(text_index.term_of, ["\U0010ffff" * 3])) < 1 << 63


def test_grams_read_few_texts(spark, grams):
    """Texts are read for verified ids: the scan has them as a pushed filter."""
    docs, index = grams
    seen = []
    real = docs.filter

    class Spy:
        def __getattr__(self, name):
            return getattr(docs, name)

        def filter(self, condition):
            seen.append(real(condition))
            return seen[-1]

    assert len(index.search(Spy(), "schule", 3)) == 3
    assert seen and all("PushedFilters: [In(id" in d._jdf.queryExecution().executedPlan().toString() and d.count() <= 6 for d in seen)
    empty = text_index.build(docs.limit(0), new_folder(spark, "grams"))
    assert empty.search(docs, "the", 5) == []
    assert text.query_tokens("") == []

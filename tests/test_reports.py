"""Percentiles and snapshot differences against plain ones."""

import random

import numpy as np
import pytest

from tessera.operators import audit, snapshots
from tessera.sources.shared import new_folder


def test_percentiles(spark, monkeypatch):
    monkeypatch.setattr(audit, "BINS", 8)  # several rounds
    rng = random.Random(1)
    groups = {"hot": [rng.choice([rng.random() * 10 ** rng.randint(-9, 9), 5.0]) for _ in range(2000)], "same": [3.5] * 20, "one": [-7.0], "two": [-1e308, 1e308], "tiny": [5e-324, 1e-323, 0.0, -5e-324], "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("hot", float("inf")), (None, 1.0)]
    at = [0.0, 0.25, 0.5, 0.999, 1.0]
    found = {(r.key, r.q): r.value for r in audit.percentiles(spark.createDataFrame(rows, "key string, v double"), "key", "v", at).collect() if r.key}
    assert set(found) == {(k, q) for k, vs in groups.items() if vs for q in at}
    for (k, q), value in found.items():
        if k == "two":  # numpy's difference of these is not finite
            continue
        assert value == pytest.approx(float(np.quantile(groups[k], q)), rel=1e-12, abs=5e-324), (k, q)


def test_changes(spark):
    old = [(i, f"n{i}", None if i % 7 == 0 else i * 1.5) for i in range(400)]
    new = [(i, n, v) for i, n, v in old if i not in (5, 6)] + [(900, "x", None)]
    new = [(i, n, 0.25 if i in (7, 8) else v) for i, n, v in new]
    new = [(i, None if i == 9 else n, v) for i, n, v in new]
    paths = [new_folder(spark, "snap") for _ in range(3)]
    for path, rows in zip(paths, (old, new, []), strict=True):
        snapshots.write(spark.createDataFrame(rows, "id long, name string, v double"), "id", path, levels=1)
    got = {(r.id, r.change) for r in snapshots.changes(spark, paths[0], paths[1], "id").collect()}
    assert got == {(5, "deleted"), (6, "deleted"), (900, "created"), (7, "changed"), (8, "changed"), (9, "changed")}
    parts = snapshots.differing(spark, paths[0], paths[1])
    assert 1 <= len(parts) <= 6 and snapshots.differing(spark, paths[1], paths[1]) == []
    plan = snapshots.changes(spark, paths[0], paths[1], "id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    assert {r.change for r in snapshots.changes(spark, paths[0], paths[2], "id").collect()} == {"deleted"}
    assert snapshots.changes(spark, paths[2], paths[1], "id").count() == len(new)

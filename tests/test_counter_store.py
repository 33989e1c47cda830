"""Counters merged from batches in any split against a recount."""

import datetime as dt
import random

import pytest

from tessera.operators import feedback
from tessera.operators.counter_store import CounterStore
from tessera.sources.shared import new_folder

SCHEMA = "event_id long, ts timestamp, context_id long, retrieval_id string, actor string, outcome string"


def events(n=400):
    rng = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(300))
    return [(i, at(), 3 if rng.random() < 0.4 else rng.randrange(30), f"r{rng.randrange(3)}", f"a{rng.randrange(3)}", rng.choice(["adopted", "corrected", "ignored", "irrelevant"])) for i in range(n)]


def counts(df):
    return {r.id: (r.adopted, r.ignored, r.active) for r in df.select("id", "adopted", "ignored", "active").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split(spark, seed):
    rows, path = events(), new_folder(spark, "counters")
    split = random.Random(seed).sample(rows, len(rows))
    cuts = [0, 150, 151, 300, 400] if seed == 1 else [0, 10, 400]
    store = CounterStore(spark, path, buckets=8)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        before = dict(store.held)
        touched = store.apply(spark.createDataFrame(split[a:b], SCHEMA), k)
        assert {x for x in store.held if store.held[x] != before.get(x)} == set(touched)  # no other bucket is written
        if b - a == 1:
            assert len(touched) == 1
    want = counts(feedback.counters(spark.createDataFrame(rows, SCHEMA)))
    assert counts(store.counters()) == want
    again = CounterStore.opened(spark, path, buckets=8)
    assert again.apply(spark.createDataFrame(split[:10], SCHEMA), len(cuts) - 2) == [] and counts(again.counters()) == want
    assert again.apply(spark.createDataFrame([], SCHEMA), 99) == [] and counts(again.counters()) == want
    assert CounterStore.opened(spark, path, buckets=8).batch_id == 99

"""Delivery states of a stream in batches, stopped and started again, against those of the table as a whole."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.shared import new_folder
from tessera.streaming import delivery

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def messages(n=40):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        at = rng.randrange(4000)
        rows.append((i, at, "created"))
        for _ in range(rng.randint(0, 6)):
            at += rng.choice([1, 5, 10, 299, 300, 301, 400])
            rows.append((i, at, rng.choice(["claimed", "claimed", "done", "failed"])))
    rows.append((-1, 100_000, "tick"))
    return sorted(((i, START + dt.timedelta(seconds=s), k) for i, s, k in rows), key=lambda r: r[1])


def by_loop(rows):
    out = {}
    for i, at, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind != "tick":
            out[i] = delivery.advanced(out.get(i, [None, 0, None, None, 0]), int(at.timestamp() * 1_000_000), kind)
    return {i: delivery.expired_state(s, 1 << 62)[:4] for i, s in out.items()}


def plain(df):
    micro = lambda c: F.unix_micros(c)
    return {r[0]: [*r[1:]] for r in df.select("event_id", "delivery_status", "attempt_count", micro("claimed_at"), micro("next_retry_at")).collect()}


def test_table(spark):
    rows = messages()
    found = delivery.states(spark.createDataFrame(rows, delivery.MESSAGE), F.lit("2030-01-01").cast("timestamp"))
    assert plain(found) == by_loop(rows) and {s[0] for s in by_loop(rows).values()} == {"pending", "processed", "retry"}
    early = delivery.states(spark.createDataFrame(rows, delivery.MESSAGE), F.lit("2024-01-01").cast("timestamp"))
    assert "processing" in {s[0] for s in plain(early).values()}


def test_stream_stopped_and_started(spark):
    rows, base = messages(), new_folder(spark, "delivery")
    for k in range(0, len(rows), 60):  # files in order of time
        spark.createDataFrame(rows[k : k + 60], delivery.MESSAGE).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = lambda: spark.readStream.schema(delivery.MESSAGE).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")

    def fails(batch_id):
        if batch_id == 1:
            raise RuntimeError("a worker is lost")

    with pytest.raises(Exception, match="a worker is lost"):
        delivery.follow(source(), f"{base}/out", f"{base}/checkpoint", before_write=fails).awaitTermination()
    delivery.follow(source(), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    assert plain(delivery.latest(spark.read.parquet(f"{base}/out"))) == by_loop(rows)


def test_one_call_for_many_events(spark):
    """Neighbouring events share a key: a call for each event would be 600 of them."""
    rows = [(i, START + dt.timedelta(seconds=i % 50 + 100 * k), kind) for i in range(600) for k, kind in enumerate(("created", "claimed"))] + [(-1, START + dt.timedelta(days=1), "tick")]
    base = new_folder(spark, "delivery")
    spark.createDataFrame(rows, delivery.MESSAGE).write.parquet(f"{base}/in")
    query = delivery.follow(spark.readStream.schema(delivery.MESSAGE).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    assert plain(delivery.latest(spark.read.parquet(f"{base}/out"))) == by_loop(rows)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 60

"""Feedback counters kept from batch to batch: deltas with retraction into buckets, of which a batch rewrites only those it touches.

A folder holds, by bucket of the context, each answer's latest outcome and each context's counters. A batch writes its buckets below a version of
its own, and then a manifest (one row a bucket) that says which version of each bucket holds; so readers see a batch whole or not at
all, and a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import feedback

BUCKETS = 64
_LATEST = "context_id long, retrieval_id string, actor string, ts timestamp, event_id long, outcome string, bucket int"
_COUNTERS = "id long, adopted long, ignored long, active long, bucket int"


def _adopted(outcome: str) -> Column:
    return F.coalesce(F.col(outcome).isin("adopted", "corrected"), F.lit(False)).cast("long")


def _ignored(outcome: str) -> Column:
    return F.coalesce(F.col(outcome).isin("ignored", "irrelevant"), F.lit(False)).cast("long")


class CounterStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.version, self.held, self.batch_id = 0, {}, -1

    @classmethod
    def opened(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> CounterStore:
        """A store as its last manifest says."""
        store = cls(spark, path, buckets)
        last = spark.read.schema("version int, bucket int, held int, batch_id long").parquet(f"{path}/manifest").orderBy(F.desc("version"))
        rows = last.join(last.agg(F.max("version").alias("version")), "version").collect()  # a row a bucket
        if rows:
            store.version, store.held, store.batch_id = rows[0].version, {r.bucket: r.held for r in rows if r.bucket >= 0}, rows[0].batch_id
        return store

    def _read(self, kind: str, schema: str, buckets) -> DataFrame:
        paths = [f"{self.path}/{kind}/version={self.held[b]}/bucket={b}" for b in buckets if b in self.held]
        if not paths:
            return self.spark.createDataFrame([], schema)
        plain = schema.rpartition(", ")[0]
        found = self.spark.read.schema(plain).parquet(*paths)
        key = "context_id" if kind == "latest" else "id"
        return found.withColumn("bucket", self._bucket(key))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def counters(self) -> DataFrame:
        """Id, adopted, ignored, active of all contexts with feedback."""
        return self._read("counters", _COUNTERS, sorted(self.held)).drop("bucket")

    def latest(self) -> DataFrame:
        return self._read("latest", _LATEST, sorted(self.held)).drop("bucket")

    def apply(self, batch: DataFrame, batch_id: int | None = None) -> list[int]:
        """Merge a batch of feedback (context_id, retrieval_id, actor, ts, event_id, outcome); the buckets that were written.

        An answer's outcome is that of its latest (ts, event_id), in whatever batch it came; one that replaces another takes the old one's
        count back (0 at least). A batch_id that is not larger than the last one's is a batch that was merged already.
        """
        if batch_id is not None and batch_id <= self.batch_id:
            return []
        rows = stored(feedback.latest(batch.select(*feedback.KEY, "ts", "event_id", "outcome")).withColumn("bucket", self._bucket("context_id")), "feedback")
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # BUCKETS at most
        version = self.version + 1
        old = self._read("latest", _LATEST, touched)
        was = old.select(*feedback.KEY, F.col("ts").alias("old_ts"), F.col("event_id").alias("old_event"), F.col("outcome").alias("old_outcome"))
        joined = rows.join(was, feedback.KEY, "left")
        newer = F.col("old_event").isNull() | (F.struct("ts", "event_id") > F.struct(F.col("old_ts").alias("ts"), F.col("old_event").alias("event_id")))
        changed = stored(joined.filter(newer), "changed")
        kept = old.join(changed.select(*feedback.KEY), feedback.KEY, "left_anti").unionByName(changed.select(*old.columns))
        kept.write.partitionBy("bucket").parquet(f"{self.path}/latest/version={version}")
        deltas = changed.groupBy(F.col("context_id").alias("id")).agg(F.sum(_adopted("outcome") - _adopted("old_outcome")).alias("d_adopted"), F.sum(_ignored("outcome") - _ignored("old_outcome")).alias("d_ignored"), F.sum(F.col("old_event").isNull().cast("long")).alias("d_active"))
        sums = [F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).cast("long").alias(c) for c in ("adopted", "ignored", "active")]
        counts = self._read("counters", _COUNTERS, touched).drop("bucket").join(deltas, "id", "full").select("id", *sums).withColumn("bucket", self._bucket("id"))
        counts.write.partitionBy("bucket").parquet(f"{self.path}/counters/version={version}")
        self.held |= dict.fromkeys(touched, version)
        self.version, self.batch_id = version, self.batch_id if batch_id is None else batch_id
        rows = [(version, b, v, self.batch_id) for b, v in self.held.items()] or [(version, -1, -1, self.batch_id)]
        self.spark.createDataFrame(rows, "version int, bucket int, held int, batch_id long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched

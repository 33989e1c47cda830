"""The audit log and reports over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

TIERS = ("strict", "best_effort", "denied")


def entries(rows: DataFrame, tier: str) -> DataFrame:
    """Rows to append, with their durability tier; empty metadata is null."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    return rows.withColumns({"tier": F.lit(tier), "metadata": F.nullif("metadata", F.lit("{}"))})


def query(log: DataFrame, actor=None, action=None, resource=None, result=None, since=None, until=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the log, newest first; times are inclusive; 200 rows at most."""
    out = log
    for column, value in (("actor", actor), ("action", action), ("resource", resource), ("result", result)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if since is not None:
        out = out.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.filter(F.col("ts") <= F.lit(until).cast("timestamp"))
    return out.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(min(limit, 200))


def latencies(log: DataFrame, key: str, value: str) -> DataFrame:
    """Exact interpolated percentiles for each key."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    return log.groupBy(key).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def pass_rates(checks: DataFrame, suite: str, passed: str) -> DataFrame:
    """D20."""
    return checks.groupBy(suite).agg(F.count("*").alias("checks"), F.count_if(passed).alias("passed"), F.round(F.avg(F.col(passed).cast("double")), 6).alias("rate"))


#: Buckets of a histogram in each round of a selection.
BINS = 1024


def percentiles(rows: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """D19 without a group in one task: key, q, value: percentiles interpolated between neighbours, exact.

    For each rank that is asked for there is a range of values that holds it, at first all of a key's. A round counts a range's values in BINS buckets
    (with partial sums, so a hot key costs a task no more than its bins) and keeps the least and largest of the bucket that holds the rank; it ends
    when they are equal. Null, NaN and infinite values are left out; a key without others has no rows.
    """
    v = F.col(value).cast("double")
    data = stored(rows.select(F.col(key).alias("key"), v.alias("v")).filter(F.abs(v) < float("inf")), "values")
    ends = data.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.col("q") * (F.col("n") - 1)
    ranks = ends.select("*", F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q")).select("*", F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank"), (place - F.floor(place)).alias("part"))
    wanted = stored(ranks.select("key", "q", "part", "rank").distinct(), "ranks")
    open_ = stored(wanted.select("key", "rank").distinct().join(ends.select("key", "lo", "hi"), "key").select("key", "rank", F.col("rank").alias("left"), "lo", "hi"), "ranges")
    known = open_.filter("lo = hi").select("key", "rank", "lo")
    while not open_.filter("lo < hi").isEmpty():
        ranges = open_.filter("lo < hi").select("key", "lo", "hi").distinct()
        inside = data.join(ranges, "key").filter("v between lo and hi")
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that the difference is finite
        inner = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BINS - 2), F.floor(share * BINS))), F.lit(1))
        place = F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), BINS - 1).otherwise(inner)  # ends have bins of their own, so each round takes them away
        bins = inside.groupBy("key", "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = bins.withColumn("before", F.sum("n").over(Window.partitionBy("key", "lo", "hi").orderBy("bin")) - F.col("n"))
        hit = open_.filter("lo < hi").join(upto, ["key", "lo", "hi"]).filter("left >= before and left < before + n")
        open_ = stored(hit.select("key", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("least").alias("lo"), F.col("most").alias("hi")), "ranges")
        known = known.unionByName(open_.filter("lo = hi").select("key", "rank", "lo"))
    sides = wanted.join(known, ["key", "rank"]).groupBy("key", "q").agg(F.first("part").alias("part"), F.min("lo").alias("a"), F.max("lo").alias("b"))
    return sides.select(F.col("key").alias(key), "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))

"""Feedback on retrieved contexts: the latest of each key, counters, quality report, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores

KEY = ["context_id", "retrieval_id", "actor"]


def latest(feedback: DataFrame) -> DataFrame:
    """One row for each (context, retrieval, actor): the last by (ts, event_id). A blank retrieval_id stands for a retrieval
    of its own."""
    own = F.when(F.trim(F.coalesce("retrieval_id", F.lit(""))) == "", F.concat(F.lit("degraded-"), "event_id")).otherwise(F.col("retrieval_id"))
    rest = [c for c in feedback.columns if c not in KEY]
    last = feedback.withColumn("retrieval_id", own).groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("last"))
    return last.select(*KEY, *[f"last.{c}" for c in rest])


def counters(feedback: DataFrame) -> DataFrame:
    """Adopted and ignored of each context. Adopted and corrected count as adopted; ignored and irrelevant as ignored."""
    rows = latest(feedback).groupBy(F.col("context_id").alias("id"))
    return rows.agg(F.count_if(F.col("outcome").isin("adopted", "corrected")).alias("adopted"), F.count_if(F.col("outcome").isin("ignored", "irrelevant")).alias("ignored"), F.count("*").alias("active"))


def quality_scores(counts: DataFrame) -> DataFrame:
    """adoption_rate and quality_score; the rate is null without samples."""
    total = F.col("adopted") + F.col("ignored")
    return counts.withColumns({"adoption_rate": F.round(F.when(total > 0, F.col("adopted") / total), 6), "quality_score": F.round(scores.quality_factor(F.col("adopted"), F.col("ignored")), 6)})


def quality_report(counts: DataFrame, contexts: DataFrame, min_active: int = 10, max_rate: float = 0.2) -> DataFrame:
    """Contexts used often and adopted seldom, most used first."""
    total = F.col("adopted") + F.col("ignored")
    poor = counts.filter((F.col("active") > min_active) & (total >= scores.MIN_SAMPLES)).withColumn("rate", F.round(F.col("adopted") / total, 6)).filter(F.col("rate") < max_rate)
    return poor.join(contexts.filter("status <> 'deleted'").select("id", "uri"), "id").select("uri", "active", "adopted", "ignored", "rate").orderBy(F.desc("active"), "uri")


def page(feedback: DataFrame, context_id: int | None = None, retrieval_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of feedback on a context or a retrieval, newest first; 500 rows at most."""
    if context_id is None and retrieval_id is None:
        raise ValueError("context_id or retrieval_id is needed")
    rows = latest(feedback)
    if context_id is not None:
        rows = rows.filter(F.col("context_id") == context_id)
    if retrieval_id is not None:
        rows = rows.filter(F.col("retrieval_id") == retrieval_id)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(min(limit, 500))

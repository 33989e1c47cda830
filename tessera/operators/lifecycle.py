"""Statuses of contexts: single transitions and the periodic sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small_side

#: (from, to): what the transition does. Others are rejected.
TRANSITIONS = {("active", "stale"), ("stale", "active"), ("stale", "archived"), ("archived", "active"), ("archived", "deleted")}


def with_defaults(own: DataFrame, defaults: DataFrame) -> DataFrame:
    """An account's own policies, and defaults for what it has none for."""
    key = ["account_id", "context_type", "scope"]
    return own.unionByName(defaults.join(own.select(*key), key, "left_anti"))


def _older(ts: str, days: str, now: Column) -> Column:
    """Strictly older than so many days; 0 days switch it off."""
    return F.coalesce((F.col(days) > 0) & (F.col(ts) < now - F.make_dt_interval(F.col(days))), F.lit(False))


def sweep(contexts: DataFrame, policies: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Contexts with `new_status` and new stale_at and archived_at, after the three passes of a sweep.

    Only accounts with change events are swept. What turns stale in this sweep is not archived by it (its stale_at is now), and what
    is archived is not deleted.
    """
    tenants = changes.select("account_id").distinct().withColumn("__swept", F.lit(True))
    joined = contexts.join(small_side(policies), ["account_id", "context_type", "scope"], "left").join(small_side(tenants), "account_id", "left")
    swept = F.coalesce("__swept", F.lit(False))
    status = (
        F.when(swept & (F.col("status") == "active") & _older("last_accessed_at", "stale_after_days", now), "stale")
        .when(swept & (F.col("status") == "stale") & _older("stale_at", "archive_after_days", now), "archived")
        .when(swept & (F.col("status") == "archived") & _older("archived_at", "delete_after_days", now), "deleted")
        .otherwise(F.col("status"))
    )
    turned = joined.withColumn("new_status", status)
    changed = F.col("new_status") != F.col("status")
    return turned.withColumns({
        "stale_at": F.when(changed & (F.col("new_status") == "stale"), now).otherwise(F.col("stale_at")),
        "archived_at": F.when(changed & (F.col("new_status") == "archived"), now).otherwise(F.col("archived_at")),
    }).select(*contexts.columns, "new_status")


def transition(contexts: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """Contexts after one status command each (id, target): status, times and `outcome` (done, no-op, rejected, none).

    Back from stale resets stale_at and last_accessed_at; back from archived leaves both.
    """
    joined = contexts.join(commands.select("id", "target"), "id", "left")
    legal = F.concat_ws(">", "status", "target").isin(*[f"{a}>{b}" for a, b in sorted(TRANSITIONS)])
    outcome = F.when(F.col("target").isNull(), "none").when(F.col("status") == F.col("target"), "no-op").when(legal, "done").otherwise("rejected")
    done, was, to = F.col("outcome") == "done", F.col("status"), F.col("target")
    fresh = done & (was == "stale") & (to == "active")
    return joined.withColumn("outcome", outcome).withColumns({
        "stale_at": F.when(done & (to == "stale"), now).when(~fresh, F.col("stale_at")),
        "archived_at": F.when(done & (to == "archived"), now).otherwise(F.col("archived_at")),
        "last_accessed_at": F.when(fresh, now).otherwise(F.col("last_accessed_at")),
        "status": F.when(done, to).otherwise(was),
    }).select(*contexts.columns, "outcome")


def touched(contexts: DataFrame, reads: DataFrame) -> DataFrame:
    """Contexts after reads (context_id, accessed_at): counts, last access; a stale one becomes active, an archived one stays."""
    seen = reads.groupBy(F.col("context_id").alias("id")).agg(F.count("*").alias("n_reads"), F.max("accessed_at").alias("__last"))
    out = contexts.join(seen, "id", "left")
    revived = F.col("__last").isNotNull() & (F.col("status") == "stale")
    return out.withColumns({"status": F.when(revived, "active").otherwise(F.col("status")), "stale_at": F.when(~revived, F.col("stale_at")), "last_accessed_at": F.coalesce("__last", "last_accessed_at"), "n_reads": F.coalesce("n_reads", F.lit(0))}).drop("__last")

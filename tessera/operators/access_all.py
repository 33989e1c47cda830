"""Read decisions for all agents: for a table of requests, and for every context with all agents at once.

Patterns meet uris by directories: a pattern's part up to its last slash is a directory, and a uri meets the patterns of the directories above
it by equi-joins, first on the directory, then on the rest cut to the lengths that patterns of that directory have. So no uri is compared
with all patterns, and none is exploded by its length. Sets of agents are bitmaps of 32,768 bits: those of a team are made once, and
contexts that have one owner and meet the same policies are one class, whose bitmaps are united once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

BITS = 32768
REASONS = ("parent team deny", "explicit deny", "explicit allow", "baseline", "no access")


def _directories(uri: Column) -> Column:
    """What stands before each slash of a uri, slash included."""
    parts = F.split(uri, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n < F.size(parts), F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))).otherwise(F.lit("")))


def matches(uris: DataFrame, policies: DataFrame) -> DataFrame:
    """Uri with the columns of each policy whose pattern it matches (only a * at the end is special). uris: distinct uri."""
    prefix = policies.filter(F.col("pattern").endswith("*")).withColumn("__key", F.expr("left(pattern, length(pattern) - 1)"))
    prefix = prefix.withColumn("__dir", F.regexp_extract("__key", "^(.*/)?", 0)).withColumn("__rest", F.expr("substring(__key, length(__dir) + 1)")).drop("__key")
    known = prefix.groupBy("__dir").agg(F.collect_set(F.length("__rest")).alias("__lengths"))  # a name is short, so lengths are few
    at = uris.select("uri", F.explode(F.array_distinct(_directories(F.col("uri")))).alias("__dir")).join(known, "__dir")
    at = at.withColumn("__tail", F.expr("substring(uri, length(__dir) + 1)")).select("uri", "__dir", "__tail", F.explode("__lengths").alias("__n")).filter("length(__tail) >= __n")
    found = at.select("uri", "__dir", F.expr("left(__tail, __n)").alias("__rest")).join(prefix, ["__dir", "__rest"]).drop("__dir", "__rest")
    exact = uris.join(policies.filter(~F.col("pattern").endswith("*")), F.col("uri") == F.col("pattern"))
    return found.select("uri", *policies.columns).unionByName(exact.select("uri", *policies.columns))


def decide_requests(requests: DataFrame, contexts: DataFrame, policies: DataFrame, visible: DataFrame, action: str = "read") -> DataFrame:
    """L05, L01 for rows of requests (request_id, agent_id, uri): request_id, agent_id, uri, reason, readable, field_masks.

    The rules are those of access.decide, for each request's own agent: a deny by a team above, any deny, the allow of highest priority (ties: smallest
    policy_id), the baseline. Requests for missing or deleted contexts have no row. visible: agent_id, path, direct.
    """
    live = contexts.filter("status <> 'deleted'").select("uri", "scope", "owner_space")
    asked = stored(requests.select("request_id", "agent_id", "uri").join(live, "uri"), "requests")
    rules = policies.filter(F.array_contains("actions", action)).select("policy_id", "pattern", "principal", "effect", "field_masks", "priority")
    met = matches(asked.select("uri").distinct(), rules)
    teams = visible.select("agent_id", F.col("path").alias("principal"), (~F.col("direct")).alias("above"))
    hits = asked.select("request_id", "agent_id", "uri").join(met, "uri").join(teams, ["agent_id", "principal"], "left").filter("above is not null or principal = agent_id")
    deny, above = F.col("effect") == "deny", F.coalesce("above", F.lit(False)) & (F.col("principal") != F.col("agent_id"))
    verdicts = hits.groupBy("request_id").agg(
        F.bool_or(deny & above).alias("a"), F.bool_or(deny).alias("d"),
        F.max(F.when(F.col("effect") == "allow", F.struct("priority", (-F.col("policy_id")).alias("first"), "field_masks"))).alias("w"),
    )
    owners = visible.select("agent_id", F.col("path").alias("owner_space"), F.lit(True).alias("member")).distinct()
    rows = asked.join(verdicts, "request_id", "left").join(owners, ["agent_id", "owner_space"], "left")
    base = F.when(F.col("scope") == "datalake", True).when(F.col("scope") == "agent", F.col("owner_space") == F.col("agent_id")).when(F.col("scope") == "team", F.col("member"))
    reason = F.when(F.col("a"), REASONS[0]).when(F.col("d"), REASONS[1]).when(F.col("w").isNotNull(), REASONS[2]).when(base, REASONS[3]).otherwise(REASONS[4])
    rows = rows.withColumn("reason", reason)
    return rows.select("request_id", "agent_id", "uri", "reason", F.col("reason").isin(*REASONS[2:4]).alias("readable"), F.when(F.col("reason") == REASONS[2], F.col("w.field_masks")).alias("field_masks"))


def numbered_agents(agents: DataFrame) -> DataFrame:
    """agent_id, bucket, bit: each agent's place in the bitmaps. Agents are dealt by hash, half a bitmap to a bucket, so no task numbers them all."""
    names = stored(agents.select("agent_id").distinct(), "agents")
    buckets = -(-names.count() // (BITS // 2)) or 1
    rows = names.withColumn("bucket", F.pmod(F.xxhash64("agent_id"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("bit", (F.row_number().over(Window.partitionBy("bucket").orderBy("agent_id")) - 1).cast("long"))
    full = F.raise_error(F.lit("a bucket has more agents than bits"))
    return stored(rows.withColumn("bit", F.when(F.col("bit") < BITS, F.col("bit")).otherwise(full.cast("long"))), "bits")


def reasons_by_uri(contexts: DataFrame, policies: DataFrame, visible: DataFrame, agents: DataFrame, action: str = "read") -> DataFrame:
    """L05 for all agents and contexts: uri, reason, n_agents, reasons that hold for none left out. Deleted contexts have no rows."""
    bits = numbered_agents(agents)
    total = bits.count()
    rules = policies.filter(F.array_contains("actions", action)).select("policy_id", "pattern", "principal", "effect")
    live = contexts.filter("status <> 'deleted'").select("uri", "scope", "owner_space")
    met = matches(live.select("uri").distinct(), rules.select("policy_id", "pattern"))
    sets = met.groupBy("uri").agg(F.array_sort(F.collect_set("policy_id")).alias("policies"))
    classes = live.join(sets, "uri", "left").withColumn("policies", F.coalesce("policies", F.array().cast("array<bigint>")))
    classes = stored(classes.withColumn("class", F.sha2(F.to_json(F.struct("scope", "owner_space", "policies")), 256)), "classes")
    kinds = classes.groupBy("class").agg(*[F.first(c).alias(c) for c in ("scope", "owner_space", "policies")])
    seen = visible.join(bits, "agent_id").groupBy(F.col("path").alias("principal"), "bucket").agg(F.bitmap_construct_agg("bit").alias("all"), F.bitmap_construct_agg(F.when(~F.col("direct"), F.col("bit"))).alias("above"))
    own = bits.groupBy(F.col("agent_id").alias("principal"), "bucket").agg(F.bitmap_construct_agg("bit").alias("all"), F.bitmap_construct_agg(F.lit(None).cast("long")).alias("above"))
    groups = stored(seen.withColumn("kind", F.lit("team")).unionByName(own.withColumn("kind", F.lit("agent"))), "groups")
    by_rule = kinds.select("class", F.explode("policies").alias("policy_id")).join(rules, "policy_id").join(groups, "principal")
    deny = F.col("effect") == "deny"
    parts = by_rule.select("class", "bucket", F.when(deny, F.col("above")).alias("a"), F.when(deny, F.col("all")).alias("d"), F.when(F.col("effect") == "allow", F.col("all")).alias("w"), F.lit(None).cast("binary").alias("b"))
    none = [F.lit(None).cast("binary").alias(c) for c in "adw"]
    everyone = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("b"))
    lake = kinds.filter("scope = 'datalake'").select("class", F.lit(0).alias("k")).join(everyone.withColumn("k", F.lit(0)), "k").select("class", "bucket", *none, "b")
    owned = kinds.filter("scope in ('agent', 'team')").select("class", F.col("owner_space").alias("principal"), F.col("scope").alias("kind")).join(groups, ["principal", "kind"])
    owned = owned.select("class", "bucket", *none, F.col("all").alias("b"))
    every = parts.unionByName(lake).unionByName(owned)
    longer = every.select("class", "bucket", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i in range(4) for c in "adwb"[: i + 1]])).alias("e")).select("class", "bucket", "e.*").filter("x is not null")
    sizes = longer.groupBy("class", "bucket", "i").agg(F.bitmap_count(F.bitmap_or_agg("x")).alias("n")).groupBy("class").agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(4)])
    numbers = [F.coalesce("n0", F.lit(0)), *[F.coalesce(F.col(f"n{i}") - F.col(f"n{i - 1}"), F.lit(0)) for i in range(1, 4)], F.lit(total) - F.coalesce("n3", F.lit(0))]
    rows = classes.join(sizes, "class", "left").select("uri", F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), n.cast("long").alias("n_agents")) for r, n in zip(REASONS, numbers, strict=True)])).alias("r"))
    return rows.select("uri", "r.*").filter("n_agents > 0")

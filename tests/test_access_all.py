"""Decisions for all agents against those for one agent at a time, and matches against plain string tests."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import access, access_all

CONTEXT = "id long, uri string, context_type string, scope string, owner_space string, status string"
POLICY = "policy_id long, pattern string, principal string, effect string, actions array<string>, field_masks array<string>, priority int"
AGENTS = ["a1", "a2", "a3", "a4"]


def world(spark, n=80):
    rng = random.Random(6)
    name = lambda: "".join(rng.choices("ab", k=rng.randint(1, 3)))
    uris = list(dict.fromkeys(["ctx://" + "/".join(name() for _ in range(rng.randint(1, 4))) for _ in range(n)] + ["ctx://", "plain", "ctx://a/", "ctx://a//b"]))
    rows = [(i, u, "resource", rng.choice(["team", "agent", "datalake", "user", None]), rng.choice(["", "t", "t/u", "v", "a1", "a2", None]), "deleted" if i % 11 == 0 else "active") for i, u in enumerate(uris)]
    patterns = ["*", "ctx://*", "ctx://a*", "ctx://a/*", "ctx://a/b*", "plain", "pl*", "ctx://*/b", *[u + "*" for u in rng.sample(uris, 8)], *rng.sample(uris, 8), "ctx://aa/aaaaaaaaaaaaaaaa*", None]
    policies = [(i, p, rng.choice(["", "t", "t/u", "a1", "a2", "a9"]), rng.choice(["deny", "allow", "allow"]), rng.choice([["read"], ["read", "write"], ["write"]]), rng.choice([None, ["x"], ["y", "z"]]), rng.randint(0, 3)) for i, p in enumerate(patterns)]
    visible = [("a1", "t/u", True), ("a1", "t", False), ("a1", "", False), ("a2", "t", True), ("a2", "", False), ("a3", "", True)]
    return spark.createDataFrame(rows, CONTEXT), spark.createDataFrame(policies, POLICY), spark.createDataFrame(visible, "agent_id string, path string, direct boolean"), uris, policies


def test_matches(spark):
    contexts, policies, _, uris, plain = world(spark)
    got = Counter((r.uri, r.policy_id) for r in access_all.matches(contexts.select("uri"), policies).collect())
    want = Counter((u, p[0]) for u in uris for p in plain if p[1] is not None and (u.startswith(p[1][:-1]) if p[1].endswith("*") else u == p[1]))
    assert got == want and sum(want.values()) > 100


def test_all_agents(spark):
    contexts, policies, visible, _, _ = world(spark)
    one_by_one = {}
    for agent in AGENTS:
        for r in access.decide(contexts, policies, access.agent_teams(visible, agent), agent).collect():
            one_by_one[agent, r.uri] = (r.reason, r.readable, r.field_masks)
    requests = contexts.select("uri").crossJoin(spark.createDataFrame([(a,) for a in AGENTS], "agent_id string")).withColumn("request_id", F.monotonically_increasing_id())
    found = access_all.decide_requests(requests, contexts, policies, visible).collect()
    assert {(r.agent_id, r.uri): (r.reason, r.readable, r.field_masks) for r in found} == one_by_one and len(found) == len(one_by_one)
    counts = Counter((uri, v[0]) for (_, uri), v in one_by_one.items())
    agents = spark.createDataFrame([(a,) for a in AGENTS * 2], "agent_id string")
    assert {(r.uri, r.reason): r.n_agents for r in access_all.reasons_by_uri(contexts, policies, visible, agents).collect()} == counts
    assert {k[1] for k in counts} == set(access_all.REASONS)


def test_nothing(spark):
    contexts, policies, visible, _, _ = world(spark, 5)
    agents = visible.select("agent_id")
    assert access_all.reasons_by_uri(contexts.limit(0), policies, visible, agents).count() == 0
    assert {r.reason for r in access_all.reasons_by_uri(contexts, policies.limit(0), visible, agents).collect()} <= {"baseline", "no access"}

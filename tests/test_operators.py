"""Facts of operators on small rows."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import access, agent_text, catalog, contexts, feedback, graph, lifecycle, longdoc, propagation, retrieval, sections, skills

CONTEXT = "id long, uri string, context_type string, scope string, owner_space string, status string, version int, l0_content string, l1_content string, l2_content string"


def ctx(spark, rows):
    return spark.createDataFrame(rows, CONTEXT)


def row(i, scope="team", owner="", status="active", body="database query", uri=None):
    return (i, uri or f"ctx://{scope}/d{i}", "resource", scope, owner, status, 1, body, body, body)


def teams(spark, rows):
    return spark.createDataFrame(rows, "path string, direct boolean")


def policies(spark, rows):
    return spark.createDataFrame(rows, "policy_id long, pattern string, principal string, effect string, actions array<string>, field_masks array<string>, priority int")


def test_deny_beats_allow_and_teams_above_come_first(spark):
    mine = teams(spark, [("a/b", True), ("a", False), ("", False)])
    pol = policies(spark, [
        (1, "ctx://team/d1", "me", "allow", ["read"], None, 100), (2, "ctx://team/d1", "me", "deny", ["read"], None, 0), (3, "ctx://team/d2", "a", "deny", ["read"], None, 0),
        (4, "ctx://user/*", "me", "allow", ["read"], ["q"], 5), (5, "ctx://user/*", "me", "allow", ["read"], None, 5), (6, "ctx://team/*/x", "me", "deny", ["read"], None, 9),
    ])
    rows = [row(1, owner="a"), row(2, owner="a"), row(3, "user", "you"), row(4, owner="a/b"), row(5, owner="z"), row(6, owner="a", status="deleted"), row(7, owner="a", uri="ctx://team/7/x")]
    got = {r.id: (r.reason, r.field_masks) for r in access.decide(ctx(spark, rows), pol, mine, "me").collect()}
    assert got == {1: ("explicit deny", None), 2: ("parent team deny", None), 3: ("explicit allow", ["q"]), 4: ("baseline", None), 5: ("no access", None), 7: ("baseline", None)}
    one = access.decide_one(ctx(spark, rows), pol, mine, "me", "ctx://team/7/x").first()
    assert one.reason == "explicit deny"  # only the single form knows a star in the middle


def test_write_needs_a_direct_membership(spark):
    members = spark.createDataFrame([("me", 1, "member", "read_write"), ("me", 2, "member", "read_only")], "agent_id string, team_id long, role string, access string")
    table = spark.createDataFrame([(0, "", None), (1, "a", 0), (2, "b", 0)], "id long, path string, parent_id long")
    rows = [row(1, owner="a"), row(2, owner="b"), row(3, owner=""), row(4, "agent", "me"), row(5, "datalake", None), row(6, "user", "me")]
    seen = graph.visible_teams(members, table)
    assert {(r.path, r.direct) for r in seen.collect()} == {("a", True), ("b", True), ("", False)}
    got = access.writable(ctx(spark, rows), seen, members, table, "me").filter("writable")
    assert {r.id for r in got.collect()} == {1, 4}


def test_masks_in_turn_and_any_case(spark):
    df = spark.createDataFrame([("Secret a.b axb", ["SECRET", "a.b"]), ("x", None), (None, ["x"]), ("y", [""])], "t string, m array<string>")
    assert [r[0] for r in df.select(text.masked(F.col("t"), F.col("m"))).collect()] == ["[MASKED] [MASKED] axb", "x", None, "y"]


def test_quality_needs_five_samples(spark):
    df = spark.createDataFrame([(8, 0), (0, 8), (0, 4), (None, None)], "a int, i int")
    assert [round(r[0], 6) for r in df.select(scores.quality_factor(F.col("a"), F.col("i"))).collect()] == [round(0.5 + 4 / 9, 6), 0.5, 1.0, 1.0]


def test_search_orders_by_quality_and_staleness(spark):
    rows = [row(1), row(2), row(3, status="stale"), row(4, body="nothing here"), row(5, status="archived")]
    counts = spark.createDataFrame([(1, 0, 8), (2, 8, 0)], "id long, adopted long, ignored long")
    got = retrieval.search(ctx(spark, rows), "database query", policies(spark, [(1, "none", "me", "deny", ["read"], None, 0)]), teams(spark, [("", True)]), counts, "me", 10)
    assert [r.id for r in got.orderBy("place").collect()] == [2, 3, 1]
    assert retrieval.search(ctx(spark, rows), " ", policies(spark, [(1, "none", "me", "deny", ["read"], None, 0)]), teams(spark, [("", True)]), counts, "me").count() == 0


def test_lineage_depth_and_cycles(spark):
    edges = spark.createDataFrame([("users", "orders"), ("orders", "items"), ("items", "users"), ("users", "items")], "upstream string, downstream string")
    assert {(r.node, r.depth) for r in graph.reachable(edges, "users").collect()} == {("orders", 1), ("items", 1)}
    assert {(r.node, r.depth) for r in graph.reachable(edges, "items", downstream=False).collect()} == {("orders", 1), ("users", 1)}


def test_lineage_deeper_than_a_hundred(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(103)] + [("n103", "n0")], "upstream string, downstream string").coalesce(1).cache()
    assert {(r.node, r.depth) for r in graph.reachable(edges, "n0").collect()} == {(f"n{i}", i) for i in range(1, 104)}


def test_feedback_latest_counts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 7, "r1", "a", "adopted"), (2, t, 7, "r1", "a", "ignored"), (3, t, 7, " ", "a", "adopted"), (4, t, 7, None, "a", "adopted")]
    got = feedback.counters(spark.createDataFrame(rows, "event_id long, ts timestamp, context_id long, retrieval_id string, actor string, outcome string")).first()
    assert (got.adopted, got.ignored, got.active) == (2, 1, 3)
    with pytest.raises(ValueError):
        feedback.page(spark.createDataFrame(rows, "event_id long, ts timestamp, context_id long, retrieval_id string, actor string, outcome string"))


def test_sweep_is_strict_and_zero_is_off(spark):
    schema = "id long, account_id string, context_type string, scope string, status string, last_accessed_at timestamp, stale_at timestamp, archived_at timestamp"
    day = lambda n: dt.datetime(2024, 2, 1) - dt.timedelta(days=n)
    rows = [(1, "acme", "memory", "agent", "active", day(91), None, None), (2, "acme", "memory", "agent", "active", day(90), None, None), (3, "acme", "memory", "agent", "stale", day(300), day(31), None), (4, "beta", "memory", "agent", "active", day(300), None, None), (5, "acme", "skill", "team", "active", day(999), None, None)]
    pol = spark.createDataFrame([(a, "memory", "agent", 90, 30, 180) for a in ("acme", "beta")] + [("acme", "skill", "team", 0, 90, 0)], "account_id string, context_type string, scope string, stale_after_days int, archive_after_days int, delete_after_days int")
    changes = spark.createDataFrame([("acme",), ("acme",)], "account_id string")
    got = {r.id: r.new_status for r in lifecycle.sweep(spark.createDataFrame(rows, schema), pol, changes, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {1: "stale", 2: "active", 3: "archived", 4: "active", 5: "active"}


def test_pinned_skill_with_newer_version(spark):
    versions = spark.createDataFrame([(1, 1, "published", "one"), (1, 2, "published", "two"), (1, 3, "published", "three"), (2, 1, "draft", "d")], "skill_id long, version int, status string, content string")
    subs = spark.createDataFrame([("me", 1, 2)], "agent_id string, skill_id long, pinned_version int")
    req = spark.createDataFrame([("me", 1, None), ("you", 1, None), ("you", 1, 1), ("me", 2, None), ("you", 1, 9)], "agent_id string, skill_id long, wanted int")
    got = {(r.agent_id, r.skill_id, r.version, r.advisory, r.error) for r in skills.resolved(req, versions, subs, spark.createDataFrame([(1, 7, "head"), (2, 1, "draft")], "id long, version int, l2_content string")).collect()}
    assert got == {("me", 1, 2, "v3 available, currently pinned to v2", None), ("you", 1, 7, None, None), ("you", 1, 1, None, None), ("me", 2, None, None, 404), ("you", 1, None, None, 404)}  # a head is the skill's own row (Q14)


def test_propagation_rules(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    changes = spark.createDataFrame([(1, t(5), 7, "version_published", 2, True), (2, t(5), 7, "deleted", 2, False), (3, t(5), 7, "modified", 1, None)], "event_id long, ts timestamp, context_id long, change_type string, new_version int, is_breaking boolean")
    edges = spark.createDataFrame([(10, 7, "skill_version", 1, t(1)), (11, 7, "skill_version", None, t(1)), (12, 7, "table_schema", None, t(1)), (13, 7, "derived_from", None, t(9))], "dependent_id long, dependency_id long, dep_type string, pinned_version int, created_at timestamp")
    subs = spark.createDataFrame([("a", 7, None), ("b", 7, 1)], "agent_id string, skill_id long, pinned_version int")
    got = {(r.event_id, r.target, r.action) for r in propagation.actions(changes, edges, subs).collect()}
    assert got == {(1, "10", "mark_stale"), (1, "11", "no_action"), (1, "12", "auto_update"), (1, "a", "notify"), (1, "b", "advisory"), (3, "10", "no_action"), (3, "11", "no_action"), (3, "12", "auto_update")}


def test_optimistic_updates(spark):
    cmd = spark.createDataFrame([(1, 1, "update", 1, "b"), (2, 1, "update", 1, "c"), (3, 1, "update", 2, "d"), (4, 1, "delete", 3, None), (5, 1, "update", 3, "e"), (6, 2, "update", None, "f")], "seq long, id long, op string, expected int, content string")
    got = {r.id: (r.version, r.status, r.l2_content, r.errors) for r in contexts.updated(ctx(spark, [row(1, status="stale"), row(2), row(3)]), cmd).collect()}
    assert got == {1: (3, "deleted", "d", 2), 2: (1, "active", "database query", 1), 3: (1, "active", "database query", 0)}


def test_second_sync_has_no_events(spark):
    new = spark.createDataFrame([("t", "d1"), ("u", "d2")], "table_name string, ddl string")
    first = catalog.synced(spark.createDataFrame([], "table_name string, ddl string, version int"), new)
    assert {(r.table_name, r.action, r.version) for r in first.collect()} == {("t", "created", 2), ("u", "created", 2)}
    assert not catalog.synced(new.join(first.select("table_name", "version"), "table_name"), new).filter("has_event").count()


def test_top_templates_of_a_large_context(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7 + 2).alias("context_id"), "id", (F.col("id") % 1000).alias("hit_count"))
    top = catalog.top_templates(rows)
    got = {r.context_id: r.templates for r in top.collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (-r.hit_count, r.id)):
        want.setdefault(r.context_id, []).append(str(r.id))
    assert got == {c: ",".join(ids[:5]) for c, ids in want.items()}
    plan = top._jdf.queryExecution().optimizedPlan().toString()  # what is collected has been cut to 5 of each salt, then of each context
    assert plan.index("collect_list") < plan.index("<= 5") and plan.count("row_number()") >= 2


def test_capture_and_recall(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "x" * 250 + "\nWhich endpoint returns the list?\nthanks"), (1, 1, "assistant", "Here is a plan that always works fine for us. The API path is /api/v1/items and requires a header. ```code must``` Short use.\n- Always send the token with each request you make."),
        (2, 0, "user", " "), (2, 1, "assistant", None), (3, 0, "user", " hi? "),
    ], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.query) for r in agent_text.recall_queries(turns).collect()} == {(1, "Which endpoint returns the list?"), (3, "hi?")}
    assert [(r.conv_id, r.memory) for r in agent_text.captures(turns).collect()] == [(1, "The API path is /api/v1/items and requires a header.\nAlways send the token with each request you make.")]


def docs_of(spark, texts, *more):
    return spark.createDataFrame([(i, t, *[m[i] for m in more]) for i, t in enumerate(texts)], "doc_id long, text string" + ", raw string" * len(more))


def test_sections_by_headings(spark):
    doc = "# One\nintro\n## Two\nbody two\n# Three\nbody three"
    rows = sections.section_rows(docs_of(spark, [doc, None, "plain"])).orderBy("doc_id", "section_no").collect()
    assert [(r.parent_no, r.title, r.depth, r.start_offset, r.end_offset) for r in rows if r.doc_id == 0] == [(None, "Document", 0, 0, 46), (0, "One", 1, 2, 15), (1, "Two", 2, 15, 30), (0, "Three", 1, 30, 46)]
    assert [(r.title, r.start_offset, r.end_offset) for r in rows if r.doc_id == 1] == [("Document", 0, 0)]
    assert [(r.title, r.start_offset, r.end_offset, r.summary) for r in rows if r.doc_id == 2] == [("Document", 0, 5, "plain"), ("Section 1", 0, 5, "plain")]


def test_section_invariants(spark):
    """Random texts with blank lines, sentences and headings of all levels."""
    rng, limit = random.Random(4), 70
    texts = ["".join(rng.choices("ab. \n#", weights=(5, 5, 1, 2, 1, k % 3), k=rng.randint(0, 3000))) for k in range(40)]
    texts += ["\n".join("#" * rng.randint(1, 6) + f" t{i}\n" + "w " * rng.randint(0, 300) for i in range(30)) for _ in range(10)]
    found = sections.section_rows(docs_of(spark, texts), max_tokens=limit).collect()
    by = {i: sorted((r for r in found if r.doc_id == i), key=lambda r: r.section_no) for i in range(len(texts))}
    for i, rows in by.items():
        assert [r.section_no for r in rows] == list(range(len(rows))) and len({r.node_id for r in rows}) == len(rows)
        assert (rows[0].start_offset, rows[0].end_offset, rows[0].parent_no) == (0, len(texts[i]), None)
        parents, stack = {r.parent_no for r in rows}, []
        for r in rows:
            assert 0 <= r.start_offset <= r.end_offset <= len(texts[i])
            while stack and stack[-1] != r.parent_no:
                stack.pop()  # pre-order: a parent is on the way back to the root
            assert r.depth == len(stack) and (r.parent_no is None) == (not stack)
            stack.append(r.section_no)
            if r.section_no and r.section_no not in parents:
                assert r.end_offset - r.start_offset < 4 * limit + 4
        leaves = [r for r in rows if r.section_no and r.section_no not in parents]
        if rows[1:] and rows[1].node_id.startswith("seq"):
            assert "".join(texts[i][r.start_offset : r.end_offset] for r in leaves) == texts[i]


def test_breaks():
    """Cuts against a search from the end of the window."""
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices("ab. \n", k=rng.randint(1, 120)))
        a = rng.randrange(len(text))
        b = rng.randint(a, len(text))
        want = next((at + n for mark, n in (("\n\n", 2), ("\n", 1), (". ", 2)) if (at := text.rfind(mark, a, b)) > a), None)
        assert sections.Breaks(text).last(a, b) == want


def test_groups_of_siblings(spark):
    """A section over the bound whose children fit is replaced by parts that hold as many of them as can be."""
    doc = "# A\n" + "".join(f"## B{i}\n" + "x" * 90 + "\n" for i in range(6)) + "# Z\nend"
    one = lambda n, up, a, b: {"node_id": n, "parent_node_id": up, "title": n, "start_offset": a, "end_offset": b, "summary": "s"}
    raw = json.dumps({"sections": [one("r", None, 0, 9), one("a", "r", 0, 582), *[one(f"b{i}", "a", 4 + 97 * i, 101 + 97 * i) for i in range(6)]]})
    rows = sections.section_rows(docs_of(spark, [doc], [raw]), proposal_col="raw", max_tokens=50).orderBy("section_no").collect()
    assert [(r.node_id, r.depth) for r in rows] == [("r", 0), ("a-part-1", 1), ("b0", 2), ("b1", 2), ("a-part-2", 1), ("b2", 2), ("b3", 2), ("a-part-3", 1), ("b4", 2), ("b5", 2)]
    assert [(r.start_offset, r.end_offset) for r in rows if r.node_id.startswith("a")] == [(4, 198), (198, 392), (392, 586)]


def test_proposed_sections(spark):
    one = lambda n, up, a=0, b=5, **more: {"node_id": n, "parent_node_id": up, "title": "t", "start_offset": a, "end_offset": b, "summary": "s"} | more
    raws = [
        "```json\n" + json.dumps({"sections": [one("a", None, 3, 1), one("b", "a", 5, 99)]}) + "\n```", json.dumps({"sections": [one("r", None), one("a", "b"), one("b", "a")]}), "no json", None, json.dumps({"sections": [one("a", None), one("a", None)]}),
        json.dumps({"sections": [one("a", "gone"), one("r", None)]}), json.dumps({"sections": [one("a", None, note=1)]}), json.dumps({"sections": [one("x", None, 0, 4), one("y", None, 4, 9), one("z", "y", 2, 3)]}), json.dumps({"sections": [one(f"n{i}", f"n{i - 1}" if i else None, 1, 2) for i in range(150)]}),
    ]
    rows = sections.section_rows(docs_of(spark, ["k" * 20] * len(raws), raws), proposal_col="raw").orderBy("doc_id", "section_no").collect()
    shown = {i: [(r.node_id, r.depth, r.start_offset, r.end_offset) for r in rows if r.doc_id == i] for i in range(len(raws))}
    assert shown[0] == [("a", 0, 0, 20), ("b", 1, 5, 20)]
    assert all(shown[i] == [("seq-root", 0, 0, 20), ("seq-0001", 1, 0, 20)] for i in (1, 2, 3, 4, 5, 6))
    assert shown[7] == [("__document_root__", 0, 0, 20), ("x", 1, 0, 4), ("y", 1, 2, 9), ("z", 2, 2, 3)]
    assert [d for _, d, *_ in shown[8]] == list(range(150))


def test_page_texts(spark):
    page = "A GREAT BOOK\nOF MANY THINGS\n\nSome text here.\nCONFERENCE ON THINGS 2024\n1\n2.1\nMETHODS USED\ntext\nCONFERENCE ON THINGS 2024\npage 2\nCONFERENCE ON THINGS 2024\nend."
    got = {r.doc_id: r.markdown for r in sections.page_texts(docs_of(spark, [page, None, "", "3 RESULTS\n\n\n a  b \nREFERENCES\nNOTES"])).collect()}
    assert got == {0: "# A GREAT BOOK OF MANY THINGS\n\nSome text here.\n### 2.1 METHODS USED\ntext\nend.", 1: "", 2: "", 3: "## 3 RESULTS\n\na b\n## REFERENCES\nNOTES"}


def test_snippets_by_tree_and_windows(spark):
    body = "# Alpha\n" + "filler words here. " * 600 + "\n# Beta\nThe quantum engine needs calibration. " + "other words there. " * 600
    docs = spark.createDataFrame([(1, body), (2, "nothing"), (3, None)], "id long, text string")
    pool = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 1.0), (3, 1.0, 1.0)], "id long, score double, rerank_score double")
    rows = sections.section_rows(docs.withColumnRenamed("id", "doc_id"))
    got = {r.id: r for r in longdoc.snippets(pool, docs, rows, "quantum engine calibration").collect()}
    assert "quantum engine needs calibration" in got[1].snippet and got[1].strategy in ("tree", "keyword")
    assert got[3].snippet is None and got[3].rerank_score == 1.0


def runs_of(x):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").lower()).split()


def worth(part, words, phrase):
    n = [part.count(w) for w in words]
    return phrase in " ".join(runs_of(part)), sum(x > 0 for x in n), round(sum(n) / max(1, len(part)), 12)


def test_windows_brute_force(spark):
    """Best windows and keyword windows of random texts against all places of the words."""
    rng = random.Random(3)
    texts = ["".join(rng.choices(["engine ", "quantum ", "calibration ", "filler ", "x" * 40 + " ", "other. "], weights=(1, 1, 1, 20, 20, 20), k=rng.randint(0, 500))) for _ in range(12)] + ["", "no hits here"]
    query, size = "quantum engine calibration", 400
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in df.select("doc_id", longdoc.best_window(F.lower("text"), query, size).alias("w"), longdoc.keyword_window(F.lower("text"), query).alias("k")).collect()}
    words, phrase = query.split(), query
    for i, t in enumerate(texts):
        hits = sorted({at for w in words for at in range(len(t)) if t.startswith(w, at)})
        spans = {(a, min(len(t), max(h + 1, a + size))) for h in hits for a in (max(0, h - size // 2), max(0, h - size // 3), max(0, min(h, len(t) - size)))}
        spans = {(a, b) for a, b in spans if any(a <= h < b for h in hits)}
        best = max((worth(t[a:b], words, phrase) for a, b in spans), default=None)
        assert (got[i].w is None) == (best is None)
        if best:
            assert (got[i].w.a, got[i].w.b) in spans and worth(t[got[i].w.a : got[i].w.b], words, phrase) == best
        assert (got[i].k is None) == (not hits)
        if hits:
            assert got[i].k.a <= hits[-1] and got[i].k.b - got[i].k.a <= longdoc.SNIPPET and 0.8 <= got[i].k.factor <= 1.2 and any(got[i].k.a <= h < got[i].k.b for h in hits)


def test_access_many_policies(spark, monkeypatch):
    """Decisions in place and by joins are the same."""
    rows = ctx(spark, [row(1, "team", "a"), row(2, "team", "b"), row(3, "agent", "me"), row(4, "datalake"), row(5, "team", None), row(6, "team", "a", "deleted")])
    pol = policies(spark, [(1, "ctx://team/*", "a", "deny", ["read"], None, 1), (2, "ctx://team/d1", "me", "allow", ["read"], ["x"], 5), (3, "ctx://datalake/d4", "me", "deny", ["read"], None, 1), (4, "ctx://agent/*", "me", "allow", ["read"], ["m"], 2), (5, "ctx://agent/d3", "me", "allow", ["read"], None, 2), (6, "*", "other", "deny", ["read"], None, 9)])
    mine = teams(spark, [("a", True), ("b", False)])
    near = sorted(map(str, access.decide(rows, pol, mine, "me").collect()))
    monkeypatch.setattr(access, "MOST", 0)
    assert sorted(map(str, access.decide(rows, pol, mine, "me").collect())) == near and len(near) == 5


def test_files(spark, tmp_path):
    from tessera.sources import documents

    (tmp_path / "a.md").write_text("# ü\ntext")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# ü\ntext", None), "b.pdf": (None, "unsupported type")}


def test_stream_unique_and_windows(spark, tmp_path):
    from tessera.streaming import outbox

    t = dt.datetime(2024, 1, 1)
    outbox.append(spark.createDataFrame([(1, t, 7, "acme", "modified", 1, False)] * 3 + [(2, t + dt.timedelta(days=3), 7, "acme", "created", 1, False)], outbox.SCHEMA), str(tmp_path / "e"))
    stream = outbox.tumbling_counts(outbox.unique(outbox.read_outbox(spark, str(tmp_path / "e"))), late=None)
    run = stream.writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.change_type, r.n) for r in spark.table("counts").collect()} == {("modified", 1)}

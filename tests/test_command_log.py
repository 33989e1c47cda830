"""Commands in sequence against a plain loop over all of them."""

import random
from collections import Counter

import pytest

from tessera.operators import command_log

ROWS = "id long, version int, status string, context_type string, writable boolean, l2_content string"


def world(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 3), rng.choice(["active", "stale", "deleted"]), rng.choice(["skill", "memory"]), i % 5 > 0, f"old {i}") for i in range(12)] + [(100, 1, "stale", "memory", True, "old 100")]
    commands = []
    for seq in range(n):
        i = 100 if rng.random() < 0.6 else rng.choice([None, *range(14)])
        op = "delete" if rng.random() < (0.0005 if i == 100 else 0.05) else "update"
        expected = None if rng.random() < 0.03 else 1 + seq // 9 if i == 100 and rng.random() < 0.7 else rng.randint(1, 6)
        commands.append((seq, i, op, expected, rng.random() < 0.05, f"c{seq}"))
    return rows, commands


def loop(rows, commands):
    state = {r[0]: [r[1], r[2], r[5]] for r in rows}
    about = {r[0]: r for r in rows}
    out, events = {}, []
    for seq, i, op, expected, sets, content in commands:
        row, update = about.get(i), op == "update"
        gone = row is None or state[i][1] == "deleted"
        error = 428 if expected is None else 400 if update and sets else 404 if gone else 403 if not row[4] else 400 if update and row[3] == "skill" else 409 if expected != state[i][0] else None
        out[seq] = (error, expected + 1 if error is None else None)
        if error is None:
            events.append((seq, i, "modified" if update else "deleted"))
            state[i] = [expected + 1, "active", content] if update else [expected + 1, "deleted", state[i][2]]
    return out, events, state


@pytest.mark.parametrize(("seed", "n", "parts"), [(1, 1500, 9), (2, 400, 2), (3, 60, 7)])
def test_sequence(spark, seed, n, parts):
    rows, commands = world(seed, n)
    contexts, log = spark.createDataFrame(rows, ROWS), spark.createDataFrame(random.Random(0).sample(commands, n), "seq long, id long, op string, expected int, sets_status boolean, content string")
    results = command_log.stored(command_log.sequenced(contexts, log, parts), "results")
    want, events, state = loop(rows, commands)
    assert {r.seq: (r.error, r.version_after) for r in results.collect()} == want and results.count() == n
    assert Counter(map(tuple, command_log.events(results, log).collect())) == Counter(events)
    assert {r.id: [r.version, r.status, r.l2_content] for r in command_log.applied(contexts, results, log).collect()} == state
    if n > 1000:  # the hot row reaches over many parts and takes many versions
        assert state[100][0] > 50 and {c for c, _ in want.values()} == {None, 400, 403, 404, 409, 428}


def test_no_commands(spark):
    rows, _ = world(1, 0)
    log = spark.createDataFrame([], "seq long, id long, op string, expected int, sets_status boolean, content string")
    assert command_log.sequenced(spark.createDataFrame(rows, ROWS), log).count() == 0

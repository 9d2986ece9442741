"""The trie against brute force, contraction on trees of all shapes."""

import hashlib
import random
import zlib

import pytest

from tallyband.llm import prefix_trie


def brute(rows):
    """rows: conv_id, turn, role, text."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own)] for c, own in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = turns.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, own in made.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        members, own = nodes[path], kids.get(path, [])
        saved = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        leaves = 1 if not own else 0
        for k in own:
            leaves, saved = leaves + out[k][5], saved + out[k][6]
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out[path] = (min(members), len(path), parent, len(members), len(own), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def found(spark, rows, parts=3):
    more = [(*r, "x", 1, 2, 3, "t") for r in rows]
    table = spark.createDataFrame(more, "conv_id long, turn long, role string, text string, key string, v int, k int, pos int, tag string").repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(table).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None, "long text " * 20])) for c in [*range(-7, 40), 1000, 1002] for _ in range(rng.randrange(10))]
    rows += [(c, t, "user", "same") for c in range(50, 75) for t in range(c % 4 + 1)]
    rows += [(None, 1, "user", "lost"), *rows[:12], *rows[:12]]
    assert found(spark, rows) == brute(rows)


def test_one_conversation_with_most_turns(spark):
    """A chain of many turns is split over tasks and contracted in few rounds."""
    rng = random.Random(6)
    rows = [(10, t, "user", rng.choice("abc")) for t in range(3000)] + [(c, t, "user", "q") for c in range(400, 500) for t in range(12)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("kind", ["chain", "star", "random", "caterpillar"])
def test_contraction(spark, kind):
    rng = random.Random(7)
    n = 150
    parent = {"chain": lambda v: v - 1, "star": lambda v: 0, "random": lambda v: rng.randrange(v), "caterpillar": lambda v: v - 1 if v % 2 else max(0, v - 2)}[kind]
    up = {v: parent(v) if v else None for v in range(n)}
    weight = {v: (rng.randrange(100), 1) for v in range(n)}
    table = spark.createDataFrame([(v, p, *weight[v]) for v, p in up.items()], "v long, p long, a long, b long")
    want = {v: list(weight[v]) for v in range(n)}
    for v in range(n - 1, 0, -1):
        want[up[v]] = [x + y for x, y in zip(want[up[v]], want[v], strict=True)]
    got = {r.v: [r.a, r.b] for r in prefix_trie.subtree_sums(table, ("a", "b"), most_rounds=40).collect()}
    assert got == want

"""The trie of rebuilt conversations against a literal one, on odd rows, negative ids and small buffers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def truncated(c):
    return c - int(np.fmod(c, trie.FAMILY))


def wanted(rows):
    """Rows of the contract from rows (conv_id, turn, role, text) without ties in turn."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {c: tuple(own.get(truncated(c), [])[: trie.base_turns(c)] + turns[trie.base_turns(c) :]) for c, turns in own.items()}
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    found = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = ",".join(map(str, sorted(c for c in members if built[c] == path)))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        found.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def rows_of(n, seed, least=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(least, least + n):
        if rng.random() < 0.1:
            continue
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["hi", "a longer ü text", "", "yes"]))))
    return rows


@pytest.mark.parametrize("held", [trie.HELD, 1])
def test_trie_against_python(spark, monkeypatch, held):
    """Families with and without their base, ids below 0, and buffers that hand on a family in pieces."""
    monkeypatch.setattr(trie, "HELD", held)
    rows = rows_of(350, 1) + rows_of(260, 2, -330) + [(1000, None, None, None), (1000, 3, "user", "hi"), (5077, 2, "user", None)]
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == wanted(rows)


def test_hot_conversation_and_long_ones(spark):
    """A third of all conversations are equal; one has a thousand turns; very long texts; clashing names."""
    rows = [(c, t, "user", "same" * 5) for c in range(0, 400) for t in range(3)] + rows_of(300, 4, 2000) + [(9000, t, "user", str(t % 7)) for t in range(1000)] + [(9100, 0, "user", "z" * 300_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("node", "members", "base", "mark", "size", "self", "key", "total")})
    assert sorted(map(tuple, trie.prefix_trie(frame).collect()), key=repr) == wanted(rows)


def test_odd_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    # repeated rows are turns of their own, role and text don't run into each other
    rows = [(100, 0, "a", "b"), (100, 0, "a", "b"), (200, 0, "ab", "")]
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.depth, r.conv_id) for r in found) == [(0, 100), (1, 100), (1, 200), (2, 100)]
    # a conversation whose turns are all replaced by those of an absent base is the root itself
    lone = next(c for c in range(101, 200) if trie.base_turns(c) > 0)
    (root,) = trie.prefix_trie(spark.createDataFrame([(lone, 0, "user", "x")], SCHEMA)).collect()
    assert tuple(root) == (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())

"""The prefix trie against a plain one, with shards so small that the skeleton matters."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clientele.llm import trie
from clientele.llm.queries import rebuilt_conversations
from clientele.session import scratch_dir
from tests.llm.data import CLASHES

ROWS = "conv_id long, turn long, role string, text string"


def plain(paths: dict[int, list[tuple[str, int]]]) -> set[tuple]:
    members = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = set()
    for path, convs in members.items():
        below, leaves, saved = [path], 0, 0
        while below:
            node = below.pop()
            leaves += not children[node]
            saved += (len(members[node]) - 1) * (node[-1][1] if node else 0)
            below += children[node]
        ends = sorted(c for c in convs if len(paths[c]) == len(path))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]),
                 leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def found(spark, paths: dict[int, list[tuple[str, int]]]) -> set[tuple]:
    rows = [(c, [(hashlib.sha256(k.encode()).hexdigest()[:2 * trie.KEY], size) for k, size in path]) for c, path in paths.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<key:string,size:int>>")
    got = [tuple(r) for r in trie.prefix_trie(df, scratch_dir(spark, "trie-test")).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("turns", [2, 4096])
def test_skeleton_of_many_shards(spark, monkeypatch, turns):
    """Deep common beginnings, a third of all conversations alike, empty ones, negative
    ids; shards of a few rows and, once, splitters cut after two turns."""
    monkeypatch.setattr(trie, "SHARD_ROWS", 12)
    monkeypatch.setattr(trie, "SKELETON_TURNS", turns)
    rng = random.Random(turns)
    paths = {}
    for c in range(-40, 260):
        if c % 3 == 0:
            paths[c] = [("same", 7)] * 4
        else:
            paths[c] = [(rng.choice("ab") + str(d // 3), d) for d in range(rng.choice([0, 1, 2, 3, 9, 40]))]
    assert found(spark, paths) == plain(paths)


def test_small_and_empty(spark):
    assert found(spark, {}) == set()
    assert found(spark, {5: []}) == plain({5: []})
    assert found(spark, {5: [], 9: [("x", 3)] * 60}) == plain({5: [], 9: [("x", 3)] * 60})
    long = found(spark, {4: [("x", 3)] * 3000, 9: [("x", 3)] * 3000})
    assert len(long) == 3001 and {(r[0], r[3], r[5]) for r in long} == {(4, 2, 1)} and max(r[6] for r in long) == 9000


def test_odd_rows_are_ordered_and_rebuilt(spark):
    """Null turns come first, null role and text are empty, repeated rows are turns, rows
    without conv_id go, other columns do not matter, roles do not run into texts."""
    rows = [(1, None, "user", "z"), (1, 0, None, None), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "lost"),
            (2, 3, "ab", "c"), (3, 3, "a", "bc"), (4, 0, "user", "é\U0001F600" * 20_000)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in CLASHES})
    turns = {r["conv_id"]: r["turns"] for r in trie.ordered_turns(df).collect()}
    assert {c: [t["size"] for t in t_] for c, t_ in turns.items()} == {1: [1, 0, 0, 0], 2: [1], 3: [2], 4: [40_000]}
    assert turns[1][2] == turns[1][3] and turns[1][1] != turns[1][2] and turns[2][0]["key"] != turns[3][0]["key"]
    # conversation 0 is missing, so nothing replaces the turns these lose
    rebuilt = {r["conv_id"]: len(r["turns"]) for r in rebuilt_conversations(df).collect()}
    assert set(rebuilt) == {1, 2, 3, 4} and all(n <= len(turns[c]) for c, n in rebuilt.items())
    assert rebuilt_conversations(df.limit(0)).count() == 0

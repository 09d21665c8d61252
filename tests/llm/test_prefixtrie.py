"""The prefix trie against a plain walk over all rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from folioflow.llm import prefixtrie
from folioflow.llm.queries import QUERIES

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            turns[conv].append((turn is not None, turn or 0, said, role, text))
    for v in turns.values():
        v.sort()
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        said = [(t[3], t[4]) for t in turns.get(c - base, [])[:h] + turns[c][h:]]
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append((c, len(said)))
    out = []
    for path, found in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c, n in found if n == len(path))
        out.append((
            min(found)[0], len(path), min(members[path[:-1]])[0] if path else None, len(found),
            sum(len(p) == len(path) + 1 for p in below), sum(not any(len(q) > len(p) and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_paths", [1, 2, 3, 5, 1000])
@pytest.mark.parametrize("seed", [0, 1])
def test_random_conversations(spark, seed, block_paths):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-10, 90), 70):
        for turn in range(rng.randrange(0, 12)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", None]), rng.choice(["a", "a", "a", "é" * 3, None])))
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(prefixtrie.trie(turns, block_paths)) == brute(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "x"), (5, None, None, None), (5, None, "user", ""), (5, 1, "user", "y"), (5, 1, "user", "y"), (6, 0, "user", "é" * 50_000),
        (1, 3, "user", "z"), (3, 0, "a", "b"), (3, 0, "ab", ""),
    ]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", path string, n long")
    assert found(prefixtrie.trie(turns)) == brute(rows)
    assert prefixtrie.trie(turns.limit(0)).count() == 0


def test_long_shared_conversation(spark):
    rows = [(c, t, "user", f"{t}") for c in range(0, 40) for t in range(300 - (c % 7))]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert found(prefixtrie.trie(turns, 2)) == found(prefixtrie.trie(turns))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_prefix_trie"](spark, sf)) == brute(rows)

"""The prefix trie against a trie of dictionaries, and its SQL on the smallest tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from seine.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, key string, block int, home string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(base, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def found(spark, turns, **kw):
    got = trie.trie(spark.createDataFrame(turns, SCHEMA).repartition(3), **kw)
    assert got.columns == NAMES
    return sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())


def row(conv, turn, role, text):
    return (conv, turn, role, text, 1, "k", 2, "h")


@pytest.mark.parametrize("rows_a_block", [1, 7, 10_000])
@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, rows_a_block):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 700), 120):
        same = rng.random() < 0.35  # a hot group of equal conversations
        for t in range(4 if same else rng.randrange(1, 9)):
            rows.append(row(c, t, "user" if t % 2 == 0 else None, "hot" if same else rng.choice(["a", "bb", "", None, "é😀"])))
    for t in range(60):
        rows.append(row(701, t, "user", "a"))  # one long conversation
    rng.shuffle(rows)
    assert found(spark, rows, rows=rows_a_block) == brute(rows)


def test_odd_rows(spark):
    rows = [row(None, 0, "user", "x"), row(5, None, "a", "z"), row(5, 0, "a", "y"), row(5, 0, "a", "y"), row(5, 0, None, None), row(3, 7, "r", "long " * 50_000), row(100, 1, "r", "t"), row(104, 2, "r", "t"), row(-5, 0, "r", "t")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == []
    turnless = [row(c, 0, "r", "t") for c in range(1, 60)]  # those whose first turn is replaced by an absent one keep nothing
    assert found(spark, turnless, rows=5) == brute(turnless) and brute(turnless)[0][1] == 0


def test_shared_turns():
    a, b = bytes(range(16)), bytes(range(1, 17))
    assert [trie.shared_turns(x, y) for x, y in [(b"", a), (a, a), (a + b, a + a), (a * 9 + b, a * 9 + a), (a + b + a, b)]] == [0, 1, 1, 9, 0]

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from edge_cases import keep

from inspectlake.llm import prefixes

SCHEMA = "conv_id long, turn int, role string, text string, depth int, path string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest())
        for p, m in members.items()
    )


def result(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    built = prefixes.with_borrowed_heads(prefixes.paths_of(table))
    found = prefixes.trie(built, keep, **kw).select(*prefixes.NODE, "ends_sha256").collect()
    return sorted((tuple(r) for r in found), key=lambda r: (r[0], r[1]))


def conversations(seed, n, most=6, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        for turn in range(rng.randrange(1, most)):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["a b", "c", "", None][: texts + 1])))
    return rows


@pytest.mark.parametrize("least_rows", [1, 2, 5, 256])
def test_same_nodes_as_brute_force(spark, least_rows):
    rows = conversations(least_rows, 150)
    assert result(spark, rows, least_rows=least_rows) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_one_hot_conversation_and_deep_ones(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS_PER_PIECE", 7)
    same = [(c, t, "user", f"t{t}") for c in range(0, 60) for t in range(3)]
    deep = [(c, t, "user", f"{t if t < 150 else (c, t)}") for c in range(100, 104) for t in range(200)]
    nested = [(c, t, "user", "x") for c in range(200, 230) for t in range(c - 199)]
    rows = same + deep + nested
    for least_rows in (1, 3, 256):
        assert result(spark, rows, least_rows=least_rows) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_edge_rows(spark):
    long = "w " * 200_000
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, None, None, None), (1, 0, "user", long), (2, 0, "user", "b"), (2, 0, "assistant", "b"), (2, 0, "user", "a"), (3, 5, "", "")]
    assert result(spark, rows) == sorted(brute(rows), key=lambda r: (r[0], r[1]))
    assert result(spark, []) == [] == result(spark, [(None, 1, "a", "b")])
    alone = [(2, 0, "user", "b")]
    assert result(spark, alone) == brute(alone)


def test_binary_searches_find_the_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.integers(0, 4, n)
        table = prefixes.sparse_table(values)
        at, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(5)))
        right, left = prefixes.right_end(table, at, depth), prefixes.left_end(table, at, depth)
        for i, d, r, s in zip(at, depth, right, left):
            assert r == next((j for j in range(i, n - 1) if values[j + 1] < d), n - 1)
            assert s == next((j for j in range(i, 0, -1) if values[j] < d), 0)

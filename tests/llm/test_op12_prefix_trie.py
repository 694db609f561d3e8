"""The prefix trie against a trie in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from echolake.llm import op12_prefix_trie as M


def plain_python(rows: list[tuple]) -> list[tuple]:
    turns: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    for own in turns.values():
        own.sort(key=lambda x: x[:3])
    told = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        told[c] = tuple((x[3], x[4]) for x in turns.get(base, [])[:h] + own[h:])
    members: dict[tuple, list[int]] = defaultdict(list)
    for c, seq in told.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children: dict[tuple, list] = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(told[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(map(tuple, M.prefix_trie(df).collect()))
    assert got == sorted(plain_python(rows))
    return got


def test_awkward_conversations(spark, monkeypatch):
    monkeypatch.setattr(M, "IDS_PER_CHUNK", 3)
    rows = [(1, 0, "user", "hi"), (1, None, None, None), (1, 1, "user", "x"), (1, 1, "assistant", "x"), (1, 1, "user", "x"), (None, 0, "user", "lost"), (-5, 0, "user", "hi"), (-205, 1, "user", "é😀"), (99, 3, "", "")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in range(200, 240) for t in range(c % 7)]  # shared first turns, ties
    rows += [(c, 0, "user", "same") for c in range(1000, 1030)]
    rows += [(300, t, "user", f"long {t % 3}") for t in range(70)] + [(301, t, "user", f"long {t % 3}") for t in range(69)]
    assert len(check(spark, rows)) > 50


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, monkeypatch, seed):
    monkeypatch.setattr(M, "ROUNDS_PER_TABLE", 2)
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 12)):
            rows.append((c * rng.choice([1, 1, 37]), t, rng.choice(["user", None]), rng.choice(["a", "b", None])))
    check(spark, rows)


def test_chains_below_chains(spark):
    """Each conversation leaves the one before at its next turn: chain of chains, rounds by doubling."""
    rows = [(100 * c, t, "u", f"{t}" if t < c or t == 39 else f"{c} {t}") for c in range(1, 33) for t in range(34)]
    check(spark, rows)

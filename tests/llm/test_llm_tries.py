"""Prefix trie against a walk over all conversations; nulls, ties, long and shared paths."""

import hashlib
import random
import re
import zlib

import pytest

from brickyard.llm import tries


def _rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    turns = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    return out


def _walk(rows):
    members, ends = {}, {}
    for c, s in _rebuilt(rows).items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
                  for p, m in members.items())


def _trie(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS depth", "2 AS pos", "3 AS id", "4 AS block", "5 AS part")
    return sorted(map(tuple, tries.conversation_trie(frame, **options).collect()))


@pytest.mark.parametrize("width", [2, 8])
def test_trie_equals_a_walk(spark, width):
    rng, rows = random.Random(width), []
    for c in rng.sample(range(90), 60):
        for turn in range(rng.choice([1, 2, 3, 9, 17])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi there", "a", "b  c\td"])))
    rows += [(100, None, "user", None), (100, 0, None, "x"), (100, 0, None, "x"), (100, 0, "user", ""),
             (None, 1, "user", "lost"), (101, 5, "user", "y"), (7, None, None, None), (7, None, "z", "w " * 20_000)]
    assert _trie(spark, rows, width=width) == _walk(rows)


def test_conversation_over_many_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 3)
    monkeypatch.setattr(tries, "RANGE_ROWS", 40)
    monkeypatch.setattr(tries, "RANGE", 2)
    long = [(0, t, "user", f"turn {t % 7}") for t in range(150)]
    rows = long + [(c, t, r, x) for c in (40, 41, 60, 63, 80) for _, t, r, x in long[:100 + c]]
    rows += [(c, 0, "user", "turn 0") for c in range(120, 180)]  # one group of equal conversations
    assert _trie(spark, rows, width=4) == _walk(rows)


def test_no_conversations_no_nodes(spark):
    assert _trie(spark, []) == [] and _trie(spark, [(None, 1, "a", "b")]) == []


def test_shared_prefix_is_combined_before_the_shuffle(spark):
    rows = spark.range(4000).selectExpr("id AS conv_id", "0L AS turn", "'system' AS role", "'same first turn' AS text")
    got = {r.depth: r for r in tries.conversation_trie(rows).collect() if r.n_convs > 1 or r.depth}
    root, first = got[0], got[1]
    assert (root.n_convs, first.n_convs) == (4000, first.n_convs) and first.n_leaves == 1
    assert root.saved_tokens == (first.n_convs - 1) * 3 and root.n_leaves == 1

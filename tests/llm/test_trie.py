"""The conversation trie against a dictionary of all beginnings, and its LOUDS arrays."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parlance.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn, role or "", text or ""))
    label = lambda x: hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, label(x)))] for c, v in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        paths[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(seed=3):
    r = random.Random(seed)
    rows = []
    for c in [*range(150), 300, 1000, 1205, -7, -200, 2**53 + 1]:
        for t in range(r.choice([1, 1, 2, 5, 7, 9])):
            text = r.choice(["a", "b", "c é 𝒳", None, ""]) if t > 2 else r.choice(["sys", "sys", "hi"])
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None]), text))
    rows += [(None, 1, "user", "of no conversation"), rows[0], rows[0]]  # repeated rows
    rows += [(400 + k, 0, "user", "the same start") for k in range(60)]  # copies
    rows += [(700 + k, t, "user", "the same start" if t < 3 else f"{k}") for k in range(40) for t in range(6)]  # one long beginning
    rows += [(5000, t, "user", str(t % 3)) for t in range(400)]  # a long conversation
    return rows


@pytest.mark.parametrize("limit", [4096, 60, 1])
def test_trie_is_the_dictionary_of_beginnings(spark, limit):
    rows = conversations()
    found = Counter(tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), limit).collect())
    assert found == brute(rows)


def test_edges(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(150, 0, "user", "dropped: its family's first is absent")]
    assert [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(only, SCHEMA)).collect()] == list(brute(only))
    nulls = [(100, None, None, None), (100, None, None, None)]
    clashing = spark.createDataFrame([(*r, 1, b"x", 2) for r in nulls], SCHEMA + ", path long, labels binary, depth int")
    assert Counter(tuple(r) for r in prefix_trie.conversation_trie(clashing).collect()) == brute(nulls)


def test_louds():
    a, b, c = (bytes([x]) * 16 for x in b"abc")
    trie = prefix_trie.Trie([a + b, b"", a, b + c + c, a + c, a + b])
    assert "".join(str(int(x)) for x in trie.bits) == "1101101000100"[: 2 * trie.n - 1]
    assert trie.n == 7 and trie.depth.tolist() == [0, 1, 1, 2, 2, 2, 3]
    assert trie.parents().tolist() == [-1, 0, 0, 1, 1, 2, 5] and trie.degrees().tolist() == [2, 2, 1, 0, 0, 1, 0]
    assert trie.node.tolist() == [3, 0, 1, 6, 4, 3]
    assert prefix_trie.rolled(trie, np.ones(7, np.int64)).tolist() == [7, 3, 3, 1, 1, 2, 1]

"""Importance resampling against a plain count of words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from parlance.llm import resampling
from tests.llm.fixtures import SCHEMA, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, target, percent, longest=1):
    def features(text):
        w = WORD.findall((text or "").translate(LOW))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[0])
    for x in target:
        t.update(features(x)[0])
    total = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (total[0] + 10_000.0)) / ((s[b] + 1.0) * (total[1] + 10_000.0))))
    out = []
    for doc_id, text, *_ in rows:
        found, n = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is not None, o[0] or 0, o[2], o[3]))
    n = percent * len(able) // 100
    return Counter([(*o, i + 1) for i, o in enumerate(able[:n])] + [(*o, None) for o in [*able[n:], *(o for o in out if o[1] < 20)]])


@pytest.fixture(scope="module")
def rows():
    return documents() + [(2**53 + 1, "exact id " * 30, "en", "s", 1), (None, "exact id " * 30, "en", "s", 1)]


@pytest.mark.parametrize(("percent", "longest", "group"), [(10, 1, None), (50, 1, 2_000), (100, 2, None), (0, 1, None)])
def test_rows(spark, rows, percent, longest, group, monkeypatch):
    if group:
        monkeypatch.setattr(resampling, "GROUP_BYTES", group)
    target = [r[1] for r in rows[:9]] + ["the the the zz", None, ""]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, longest=longest)
    assert Counter(tuple(r) for r in found.collect()) == brute(rows, target, percent, longest)


def test_empty_tables_and_clashing_names(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", b"k") for r in rows], SCHEMA + ", score long, range string, key binary")
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(docs, none).collect()) == brute(rows, [], 10)

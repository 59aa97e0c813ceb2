"""Streaming folds and the sweep join against plain loops; long files."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.operators import folds, sequence, sweep
from parlance.operators.folds import joined, stripped

SEG = "file_id string, seg_idx long, speaker string, start_ms long, end_ms long, text string"


def rows_of(seed: int, n: int = 400):
    r = random.Random(seed)
    rows, at = [], {"a": 0, "b": 0, None: 0}
    for i in range(n):
        f = r.choice(["a", "a", "a", "b", None])
        at[f] += r.choice([0, 0, 5, 40, 300, 900, 5000]) * (i % 50 > 0) + r.choice([0, 3])
        length = r.choice([0, 1, 30, 200, 1500, 9000, -5])
        rows.append((f, i, r.choice(["X", "X", "Y", None]), at[f], at[f] + length, r.choice(["a", "b c", " ", "d.", "嗯", None, "", "x\x1c"])))
    return rows


def by_key(rows, *columns):
    groups: dict = {}
    for row in rows:
        groups.setdefault(tuple(row[c] if c < 6 else stripped(row[5]) if row[5] is not None else None for c in columns), []).append(row)
    return [sorted(g, key=lambda x: (x[3], x[4], x[1])) for g in groups.values()]


def merged(rows, max_gap, max_dur, max_chars):
    out = []
    for group in by_key(rows, 0):
        kept = []
        for f, i, who, s, e, text in group:
            last = kept[-1] if kept else None
            both = joined(last[5], text) if last else None
            if last and who is not None and last[2] == who and s - last[4] <= max_gap and e - last[3] <= max_dur and both is not None and len(both) <= max_chars:
                start = max(last[3], s - 350) if len(stripped(last[5] or "")) <= 1 and last[4] - last[3] > 1000 and s - last[4] > 500 else last[3]
                kept[-1] = (f, last[1], who, start, e, both)
            else:
                kept.append((f, i, who, s, e, text))
        out += kept
    return Counter(out)


def bounded(rows, gap):
    out = []
    for group in by_key(rows, 0):
        end = None
        for f, i, who, s, e, text in group:
            s = end + gap if end is not None and s < end else s
            if e > s:
                out.append((f, i, who, s, e, text))
                end = e
    return Counter(out)


def apart(rows):
    out = []
    for group in by_key(rows, 0, 6):
        kept = []
        for x in group:
            if not any(min(k[4], x[4]) > max(k[3], x[3]) for k in kept):
                kept.append(x)
        out += kept
    return Counter(out)


@pytest.mark.parametrize("span", [500, 20_000, folds.SPAN])
def test_folds_are_the_loops(spark, monkeypatch, span):
    monkeypatch.setattr(folds.linear_fold, "__defaults__", (False, span))
    rows = rows_of(span)
    df = spark.createDataFrame(rows, SEG).repartition(3)
    found = lambda d: Counter(tuple(x) for x in d.select("file_id", "seg_idx", "speaker", "start_ms", "end_ms", "text").collect())
    assert found(sequence.merge_turns(df, 1000, 8000, 12)) == merged(rows, 1000, 8000, 12)
    assert found(sequence.dedupe_boundaries(df)) == bounded(rows, 40)
    assert found(sequence.chunk_dedupe(df)) == apart(rows)
    assert sequence.merge_turns(df.limit(0)).count() == 0


def test_a_million_segments_of_one_file(spark):
    """One file: as turns of one speaker without a pause (nothing starts afresh), and with pauses."""
    n = 1_000_000
    seg = spark.range(n).select(F.lit("f").alias("file_id"), F.col("id").alias("seg_idx"), F.lit("X").alias("speaker"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 1000).alias("end_ms"), F.lit("w").alias("text"))
    began = time.time()
    assert sequence.merge_turns(seg, 1600, 10_000, 80).count() == n // 10
    paused = seg.withColumn("end_ms", F.col("end_ms") - F.when(F.col("seg_idx") % 5 == 4, 500).otherwise(0))
    assert sequence.merge_turns(paused, 400, 10_000, 80).count() == n // 5
    assert time.time() - began < 300


def test_pairs_are_all_overlaps(spark):
    r = random.Random(8)
    side = lambda n, longest: [(r.choice(["a", "b", None]), i, s, s + r.choice([0, -3, 1, r.randrange(longest), 5 * longest])) for i in range(n) for s in [r.randrange(4000)]]
    left, right = side(300, 60), side(300, 90)
    schema = "file_id string, seg_idx long, start_ms {0}, end_ms {0}"
    for kind in ("long", "double"):
        one, two = (spark.createDataFrame([(f, i, *(float(x) if kind == "double" else x for x in t)) for f, i, *t in d], schema.format(kind)).repartition(3) for d in (left, right))
        for pad in (0, 25):
            want = Counter()
            for f, i, s, e in left:
                for g, j, t, u in right:
                    t, u = (max(t - pad, 0), u + pad) if pad else (t, u)
                    if f is not None and f == g and e > s and u > t and min(e, u) > max(s, t):
                        want[f, i, j, min(e, u) - max(s, t)] += 1
            for bucket in (7, 100, 600_000, None):
                got = sweep.overlap_join(one, two, pad, bucket).select("file_id", "seg_idx", "r_seg_idx", "overlap").collect()
                assert Counter(tuple(x) for x in got) == want, (kind, pad, bucket)
    assert sweep.overlap_join(one.limit(0), two, bucket=None).count() == 0


def test_only_overlapping_pairs_are_formed(spark):
    """A hundred thousand regions of one file, each over about ten others: rows of the scan are the rows kept."""
    n = 100_000
    one = spark.range(n).select(F.lit("f").alias("file_id"), F.col("id").alias("seg_idx"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 9_500).alias("end_ms"))
    began = time.time()
    assert sweep.bucket_width(one, one) == 8 * 9_500
    assert sweep.overlap_join(one, one, bucket=None).count() == n + 2 * sum(n - k for k in range(1, 10))
    assert time.time() - began < 120


def test_long_texts_by_diagonals():
    """The same counts as row by row; a million tokens with one edit in a hundred."""
    import numpy as np

    from parlance.operators import evaluate

    r = random.Random(11)

    def edited(tokens, share, words):
        out = []
        for t in tokens:
            x = r.random()
            out += [] if x < share / 3 else [t, r.choice(words)] if x < 2 * share / 3 else [r.choice(words)] if x < share else [t]
        return out

    for _ in range(150):
        words = range(r.choice([2, 3, 50]))
        a = r.choices(words, k=r.randrange(0, 60))
        b = edited(a, r.choice([0.05, 0.3, 1.0]), words)
        one, other = np.array(a, np.int64), np.array(b, np.int64)
        assert evaluate.counts_by_diagonals(one, other, 200) == evaluate.counts_by_rows(one, other), (a, b)
    a = r.choices(range(300), k=3000)
    b = edited(a, 0.1, range(300))
    assert evaluate.counts_by_diagonals(np.array(a), np.array(b), 3000) == evaluate.counts_by_rows(np.array(a), np.array(b))
    assert evaluate.counts_by_diagonals(np.array(a), np.array(b), 20) is None
    a = [str(r.randrange(20_000)) for _ in range(1_000_000)]
    b = edited(a, 0.01, a[:1000])
    began = time.time()
    d, *ops = evaluate.edit_counts(a, b)
    assert sum(ops) == d and 9_000 < d < 10_600 and ops[1] - ops[2] == len(b) - len(a)
    assert time.time() - began < 120

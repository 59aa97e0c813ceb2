"""Segments against all intervals, the law against draws from it, labels against those held out."""

import random

import numpy as np

from parlance.llm import toxicity
from tests.llm.fixtures import prose


def brute_segments(scores):
    """Repeatedly the interval of greatest sum (the shortest, then the first), left and right of it again."""

    def part(low, high):
        best = max(((sum(scores[i:j]), i - j, -i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return [*part(low, i), (best[0], i, j), *part(j, high)]

    return part(0, len(scores))


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.choice([-3, -2, -1, 1, 2, 4]) for _ in range(r.randrange(0, 14))]
        assert toxicity.maximal_segments(np.array(scores, float)) == [(float(s), i, j) for s, i, j in brute_segments(scores)]
    long = np.where(np.arange(300_000) % 7 == 0, 3.0, -1.0)
    assert len(toxicity.maximal_segments(long)) > 1


def test_law_and_curve():
    r = np.random.default_rng(2)
    length = r.integers(20, 2000, 4000).astype(float)
    best = (np.log(0.02 * length) - np.log(-np.log(r.random(4000)))) / 0.7
    rate, k = toxicity.fitted_law(length, best, np.ones(4000))
    assert abs(rate - 0.7) < 0.05 and 0.014 < k < 0.028
    x = toxicity.surprise(np.array([100.0, 100.0, 0.0]), np.array([30.0, 1.0, 0.0]), (rate, k))
    assert x[0] > 5 > x[1] >= 0 and x[2] == 0
    a, b = toxicity.fitted_curve(np.array([0.0, 1.0, 4.0]), np.array([1.0, 5.0, 50.0]), np.array([50.0, 5.0, 1.0]))
    assert a < 0 < b


def corpus():
    r = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        text, toxic = prose(r, r.choice([15, 60, 200])), i % 6 == 0
        if toxic:
            w = text.split(" ")
            for _ in range(max(2, len(w) // 15)):
                w.insert(r.randrange(len(w)), r.choice(["Wretch", "wretched", "scoundrel!", "vermin"]))
            text = " ".join(w)
        rows.append((i, text, 1.0))
        labels.append((i, int(toxic)))
    rows += [(900, None, 1.0), (901, "", 1.0), (None, "wretch " * 20, 1.0), (902, "wretched vermin " * 4000, 1.0), (3, rows[3][1], 1.0)]
    return rows, [*labels, (None, 1), (903, None), (904, 1), (0, 0)]


def test_held_out_labels(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows)
    truth = dict(labels[:500])
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[900]["score"] == by_id[901]["score"] < 0.5 and by_id[900]["n_passages"] == 0
    assert by_id[None]["predicted"] == by_id[902]["predicted"] == 1 and by_id[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)], [(None, 0)]):
        out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert sorted((r["doc_id"], r["score"], r["predicted"]) for r in out) == [(1, 0.0, 0), (2, 0.0, 0)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0

"""Pruned indexes against brute force: equal results, fewer documents scored; ids of every type."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import indexes, retrieval

IDS = {"long": [None, 2**53 + 1, 2**53, -5], "string": [None, "9007199254740993", "a", ""]}


def unit(v):
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dense_ids(spark, kind):
    rows = [(i, [1.0, float(k)]) for k, i in enumerate(IDS[kind])] + [(IDS[kind][3], None)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, vector array<float>")
    queries = spark.createDataFrame([(IDS[kind][1], [1.0, 0.0])], f"query_id {kind}, vector array<float>")
    want = [(IDS[kind][1], i, k + 1) for k, i in enumerate(IDS[kind])]
    for found in (retrieval.dense_topk(queries, docs, 4), indexes.ClusterIndex.of(docs).search(queries, 4)[0]):
        assert [tuple(r) for r in found.select("query_id", "doc_id", "rank").orderBy("rank").collect()] == want
    ties = spark.createDataFrame([(i, [1.0, 1.0]) for i in IDS[kind]], f"doc_id {kind}, vector array<float>")
    first = [r[0] for r in retrieval.dense_topk(queries, ties, 2).orderBy("rank").select("doc_id").collect()]
    assert first == [None, sorted(i for i in IDS[kind] if i is not None)[0]]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_whole_text_ids(spark, kind):
    a, b = IDS[kind][1], IDS[kind][2]
    rows = [(None, "a b"), (None, "a c"), (a, "a a"), (b, "a d"), (b, "a a e"), (IDS[kind][3], None)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(2)
    queries = spark.createDataFrame([(a, "a a")], f"query_id {kind}, query string")
    found = retrieval.whole_text_topk(queries, docs, 10).select("doc_id", "score").collect()
    # rows without an id stand alone, rows of one id are added up
    assert Counter(tuple(r) for r in found) == Counter([(None, 2), (None, 2), (a, 4), (b, 6)])


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_positions(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 300_000
        ids = spark.range(n).select((F.col("id") * 7919 % n - 5).alias("doc_id")).repartition(7)
        found = retrieval.positions(ids)
        assert found.where(F.col("rank") != F.col("doc_id") + 6).count() == 0 and found.count() == n
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def texts(n=3000):
    r = random.Random(4)
    words = [f"w{int(300 * r.random() ** 3)}" for _ in range(20_000)]
    return [(k, " ".join(r.choices(words, k=int(5 + 400 * r.random() ** 6)))) for k in range(n)]


def test_impact_index(spark):
    rows = texts()
    docs = spark.createDataFrame([*rows, (None, "w1 w1"), (7, "w3 w3"), (5000, None), (5001, "")], "doc_id long, text string").repartition(4)
    asked = [(0, "w0 w1 w250"), (1, "w7"), (2, "nothing here"), (3, None), (4, rows[5][1]), (5, "w299 w298")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = indexes.ImpactIndex.of(docs, 64)
    want = Counter(tuple(r) for r in retrieval.sparse_topk(queries, retrieval.token_postings(docs.where("doc_id is not null")), 10).select("query_id", "doc_id", "score", "rank").collect())
    assert Counter(tuple(r) for r in index.topk(queries, 10).select("query_id", "doc_id", "score", "rank").collect()) == want
    effort = {r["query_id"]: (r["n_scored"], r["n_documents"]) for r in index.effort(queries, 10).collect()}
    assert all(total == len(rows) for _, total in effort.values())
    assert max(effort[q][0] for q in (0, 1, 4)) < len(rows) / 4
    empty = indexes.ImpactIndex.of(docs.limit(0))
    assert empty.topk(queries, 3).count() == 0 and empty.effort(queries, 3).count() == 0


def test_cluster_index(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16))
    points = [unit(centres[k % 20] + 0.15 * r.normal(size=16)) for k in range(4000)]
    points[50:90] = [points[50]] * 40  # equal vectors: ties by id
    docs = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(points)] + [(9999, None)], "doc_id long, vector array<float>").repartition(4)
    queries = docs.where("doc_id % 97 = 50").withColumnRenamed("doc_id", "query_id")
    want = Counter(tuple(x) for x in retrieval.dense_topk(queries, docs.where("vector is not null"), 10).select("query_id", "doc_id", "score", "rank").collect())
    found, effort = indexes.ClusterIndex.of(docs).search(queries, 10)
    assert Counter(tuple(x) for x in found.select("query_id", "doc_id", "score", "rank").collect()) == want
    assert effort.agg(F.max("n_scored")).first()[0] < 1500 and effort.count() == queries.count()
    none = indexes.ClusterIndex.of(docs.limit(0)).search(queries, 10)
    assert none[0].count() == 0 and none[1].count() == 0
    assert indexes.ClusterIndex.of(docs).search(queries.limit(0), 10)[0].count() == 0


def test_impact_search_shuffles_no_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the w{i % 7} w{i % 11} sea") for i in range(300)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"the sea w{q}") for q in range(5)], "query_id long, query string")
    called, scores = [], indexes.ImpactIndex.scores
    monkeypatch.setattr(indexes.ImpactIndex, "scores", lambda *a: called.append(1) or scores(*a))
    found = indexes.ImpactIndex.of(docs, 16).topk(queries, 4)
    want = {tuple(r) for r in retrieval.sparse_topk(queries, retrieval.token_postings(docs), 4).select("query_id", "doc_id", "score", "rank").collect()}
    assert {tuple(r) for r in found.select("query_id", "doc_id", "score", "rank").collect()} == want
    assert called == [1]  # pairs are made for the few blocks scored first, and for no others


def test_impact_index_writes_documents_once(spark, monkeypatch):
    """One table of counted documents, one of blocks: no postings, no second copy of the tokens."""
    rows = [(i, f"the w{i % 7} w{i % 11} sea sea " * (1 + i % 3)) for i in range(300)] + [(5, "the w5 more"), (5, "more"), (None, "sea"), (900, ""), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    written, once = {}, indexes.written_once
    monkeypatch.setattr(indexes, "written_once", lambda df, name, *by: written.setdefault(name, once(df, name, *by)))
    index = indexes.ImpactIndex.of(docs, 16)
    assert [name for name, df in written.items() if {"token", "tokens"} & set(df.columns)] == ["impact-documents", "impact-blocks"]
    want = Counter()
    for i, text in rows:
        for token in (text or "").split() if i is not None else ():
            want[i, token] += 1
    got, most, total = {}, {}, Counter()
    for r in index.documents.collect():
        for token, n in zip(r["tokens"], r["times"], strict=True):
            assert (r["doc_id"], token) not in got
            got[r["doc_id"], token] = n
            at = r["class"], r["block"], token
            most[at] = max(most.get(at, 0), n)
        total[r["class"], r["block"]] += 1
    assert got == dict(want)
    assert Counter({tuple(r)[:3]: r["most"] for r in index.blocks.collect()}) == Counter(most) and index.blocks.count() == len(most)
    assert {(r["class"], r["block"]): r["n"] for r in index.sizes.collect()} == dict(total)

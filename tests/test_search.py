"""Search over an index against a plain version of the same rules."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import rewriting
from parlance.operators import predicates, retrieval

DOC = "doc_id long, file_id long, seg_idx int, text string, speaker string, start_ms long, end_ms long, intent array<string>, dataset string"


def corpus(n=60):
    r = random.Random(12)
    words = ["rent", "price", "budget", "meeting", "room", "carpet", "价格", "会议室", "反对", "news", "the", "guest", "policy"]
    rows = []
    for k in range(n):
        text = " ".join(r.choices(words, k=r.randint(3, 9)))
        rows.append((k, k // 10, k % 10, text, f"SPEAKER_0{k % 3}", 1000 * k, 1000 * k + 1500, ["提问"] if k % 4 == 0 else ["disagree"] if k % 4 == 1 else ["陈述"], "d"))
    return rows


QUERIES = [(0, "rent budget", None), (1, "speaker 1 price", None), (2, "0:10~0:30 meeting room", None), (3, "disagree with policy", None), (4, "carpet", "SPEAKER_02"), (5, "  ", None)]


def tokens(text):
    found = re.findall("[a-z0-9]+|[一-鿿]", text.lower())
    cjk = [t for t in found if re.fullmatch("[一-鿿]", t)]
    return found + [a + b for a, b in zip(cjk, cjk[1:], strict=False)]


def plain_search(rows, vectors, query_vectors, query, speaker, k):
    q = rewriting.rewrite_by_rules(query)
    speaker = speaker or q.speaker
    lists = {"semantic": {}, "keyword": {}}
    for i, variant in enumerate(q.semantic):
        v = query_vectors[variant]
        scored = [(-round(sum(a * b for a, b in zip(v, vectors[r[0]], strict=True)), 6), r[0]) for r in rows if v is not None and r[0] in vectors]
        for s, d in sorted(scored)[: 2 * k]:
            lists["semantic"][d] = max(lists["semantic"].get(d, -9), -s * (1.0 if i == 0 else 0.92))
        mine = tokens(variant)
        scored = [(-sum(mine.count(t) * tokens(r[3]).count(t) for t in set(mine)), r[0]) for r in rows]
        for s, d in sorted(x for x in scored if x[0] < 0)[: 2 * k]:
            lists["keyword"][d] = max(lists["keyword"].get(d, -9), -s * (1.0 if i == 0 else 0.9))
    ranks = {n: {d: p for p, (d, _) in enumerate(sorted(((d, round(s, 6)) for d, s in found.items()), key=lambda x: (-x[1], x[0]))[: 2 * k], 1)} for n, found in lists.items()}
    place = {r[0]: p for p, r in enumerate(rows, 1)}
    for name, given in (("speaker", speaker), ("time", q.time_range), ("intent", q.intent)):
        if given:
            ranks[name] = place
    weights = {"semantic": 1.0, "keyword": 1.0, "speaker": 1.5, "time": 1.0, "intent": 1.2}
    score, first = {}, {}
    for n, (name, found) in enumerate(ranks.items()):
        for d, p in found.items():
            score[d] = score.get(d, 0.0) + weights[name] / (60 + p)
            first.setdefault(d, (n, p))
    names = {"disagree": "反对"}
    out = []
    for d in sorted(score, key=lambda d: (-score[d], first[d])):
        r = rows[d]
        if speaker and r[4] != speaker:
            continue
        if q.time_range and min(r[6], q.time_range[1] * 1000) <= max(r[5], q.time_range[0] * 1000):
            continue
        if q.intent and not {names.get(i, i) for i in r[7]} & set(q.intent):
            continue
        out.append((d, round(score[d], 4)))
    return out[:k]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    docs = spark.createDataFrame(corpus(), DOC)
    retrieval.build_index(docs, path)
    return docs, path


def test_search_batch(spark, index):
    docs, path = index
    rows = corpus()
    vectors = {r["doc_id"]: r["vector"] for r in retrieval.hash_vectors(docs).collect()}
    variants = sorted({v for _, q, _ in QUERIES for v in rewriting.rewrite_by_rules(q).semantic})
    made = {r["doc_id"]: r["vector"] for r in retrieval.hash_vectors(spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")).collect()}
    query_vectors = {v: made.get(i) for i, v in enumerate(variants)}
    found = retrieval.Index(spark, path).search(spark.createDataFrame(QUERIES, "query_id long, query string, speaker string"), 5).collect()
    for i, query, speaker in QUERIES:
        got = [(r["doc_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])]
        want = plain_search(rows, vectors, query_vectors, query, speaker, 5)
        assert [d for d, _ in got] == [d for d, _ in want], (query, got, want)
        assert all(math.isclose(a, b, abs_tol=1.01e-4) for (_, a), (_, b) in zip(got, want, strict=True)), (query, got, want)
    for name in ("semantic", "keyword", "speaker", "time", "intent"):
        assert f"rank_{name}" in found[0].asDict()


def test_index_errors_and_cascade(spark, index, tmp_path):
    docs, path = index
    with pytest.raises(FileNotFoundError):
        retrieval.Index(spark, f"{path}/none").tables
    how, found = retrieval.search_or_fall_back(docs, path, "rent budget", 3)
    assert how == "index" and found.count() == 3
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 5, "something new about rent").otherwise(F.col("text")))
    how, _ = retrieval.search_or_fall_back(changed, path, "rent", 3)
    assert how == "rebuilt"
    how, found = retrieval.search_or_fall_back(docs.withColumn("text", F.lit("ab")), f"file://{tmp_path}/x", "ab", 3)
    assert how == "substring" and found.count() == 3
    retrieval.build_index(docs, path)

    def broken(_):
        raise RuntimeError("no encoder")

    assert retrieval.search_or_fall_back(docs, path, "rent", 2, encode=broken)[0] == "substring"


def test_probe_cases_and_positions(spark, index, tmp_path):
    docs, path = index
    got = {(r["type"], r["query"]): r["hits"] for r in retrieval.probe(docs, f"file://{tmp_path}/p").collect()}
    assert len(got) == 5 and got["speaker", "发言"] == 5 and got["intent", "提问"] == 5
    assert [(r["doc_id"], r["rank"]) for r in retrieval.positions(docs).orderBy("doc_id").collect()] == [(k, k + 1) for k in range(60)]
    assert [r["rank"] for r in retrieval.in_order(docs, F.col("doc_id") > 50, 3).orderBy("rank").collect()] == [1, 2, 3]
    cases = retrieval.self_retrieval_cases(docs, 8)
    hits = retrieval.Index(spark, path).search(cases.select("query_id", "query"), 5)
    outcomes = retrieval.self_retrieval_outcomes(cases, hits).collect()
    assert len(outcomes) == 16 and sum(r["rank"] is not None for r in outcomes) > 8
    written = [
        {"query_id": 0, "dimension": "meaning", "dataset": "d", "any_term_groups": [["rent", "budget"]]},
        {"query_id": 1, "dimension": "speaker", "dataset": "d", "speaker": "SPEAKER_01", "any_term_groups": [["PRICE"], ["rent"]]},
        {"query_id": 3, "dimension": "none", "dataset": "d", "any_term_groups": [["absent"]]},
    ]
    found = retrieval.Index(spark, path).search(spark.createDataFrame(QUERIES, "query_id long, query string, speaker string"), 5)
    ranked = {r["query_id"]: r["rank"] for r in retrieval.case_outcomes(written, docs, found).collect()}
    assert set(ranked) == {0, 1} and ranked[1] is not None


def test_model_encoding(spark):
    class Encoder:
        def encode(self, texts):
            return [[3.0, 4.0] for _ in texts], [[(0, 9.0), (7, 0.5), (7, 0.7), (8, -1.0)] for _ in texts]

    docs = spark.createDataFrame([(2**53 + 1, "x"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["vector"], r["weights"]) for r in retrieval.model_encoding(docs, Encoder).collect()}
    assert set(got) == {2**53 + 1, None}
    assert got[None][0] == pytest.approx([0.6, 0.8]) and got[None][1] == {"7": 0.7}


def test_relevance(spark):
    docs = spark.createDataFrame(corpus(8), DOC)
    case = {"dataset": "d", "speaker": "SPEAKER_00", "time_range": (0, 3500), "intent": ["提问"], "any_term_groups": [[""]]}
    assert [r["doc_id"] for r in docs.where(predicates.relevant_to(case)).collect()] == [0]


def test_search_with_constraints(spark, index):
    docs, path = index
    rows, tables = corpus(), retrieval.Index(spark, path).tables
    asked = spark.createDataFrame([(0, "rent budget room")], "query_id long, query string")
    keyword = retrieval.sparse_topk(asked, tables["postings"], 8)
    semantic = retrieval.dense_topk(retrieval.hash_vectors(asked.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))).withColumnRenamed("doc_id", "query_id"), tables["vectors"], 8)
    ranks = [{r["doc_id"]: r["rank"] for r in x.collect()} for x in (semantic, keyword)] + [{r[0]: k for k, r in enumerate(rows, 1)}] * 2
    score = {d: sum(w / (60 + r[d]) for w, r in zip((1.0, 1.0, 1.5, 1.2), ranks, strict=True) if d in r) for d in range(60)}
    right = [d for d in sorted(score, key=lambda d: (-score[d], d not in ranks[0], d not in ranks[1], d)) if rows[d][4] == "SPEAKER_01" and rows[d][7] == ["disagree"]]
    got = retrieval.search(docs, semantic, keyword, 4, speaker="SPEAKER_01", intent=["反对"]).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == right[:4]
    free = retrieval.search(docs, semantic, keyword, 4).orderBy("rank").collect()
    assert len(free) == 4 and {r["doc_id"] for r in free} <= set(ranks[0]) | set(ranks[1])


def test_self_retrieval_is_the_plain_search(spark, index):
    """Ranks of the cases that a corpus asks of itself, from plain_search."""
    docs, _ = index
    rows = corpus()
    cases = retrieval.self_retrieval_cases(docs, 8)
    asked = {r["query_id"]: r for r in cases.collect()}
    assert len(asked) == 16 and {r["mode"] for r in asked.values()} == {"exact", "partial"}
    variants = sorted({v for r in asked.values() for v in rewriting.rewrite_by_rules(r["query"]).semantic})
    vectors = {r["doc_id"]: r["vector"] for r in retrieval.hash_vectors(docs).collect()}
    made = {r["doc_id"]: r["vector"] for r in retrieval.hash_vectors(spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")).collect()}
    query_vectors = {v: made.get(i) for i, v in enumerate(variants)}
    hits = retrieval.search_batch(cases.select("query_id", "query"), docs, retrieval.token_postings(docs), retrieval.hash_vectors(docs), 5)
    got = {r["query_id"]: r["rank"] for r in retrieval.self_retrieval_outcomes(cases, hits).collect()}
    for q, case in asked.items():
        found = plain_search(rows, vectors, query_vectors, case["query"], None, 5)
        assert got[q] == next((k for k, (d, _) in enumerate(found, 1) if d == case["doc_id"] or rows[d][3] == case["text"]), None), case


def test_search_batch_makes_no_pairs_of_queries_and_documents(spark, monkeypatch):
    """Lists of few lanes, small blocks and slices agree with the inverted-index join, and constraints that queries share are met once."""
    import random

    from parlance.operators import retrieval

    monkeypatch.setattr(retrieval, "TEXT_QUERIES", 7)
    monkeypatch.setattr(retrieval, "LANES", 2)
    monkeypatch.setattr(retrieval, "CELLS", 64)
    r = random.Random(3)
    known = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(r.choices(known, k=r.randint(0, 12))), r.choice(["user", "system"]), 1000 * i, 1000 * i + 900, ["question"]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, speaker string, start_ms long, end_ms long, intent array<string>")
    asked = docs.where("doc_id % 5 = 0").selectExpr("doc_id AS query_id", "text AS query")
    postings = retrieval.token_postings(docs)
    want = {tuple(x) for x in retrieval.sparse_topk(asked, postings, 6).select("query_id", "doc_id", "score", "rank").collect()}
    assert {tuple(x) for x in retrieval.postings_topk(asked, postings, 6).select("query_id", "doc_id", "score", "rank").collect()} == want
    called = []
    monkeypatch.setattr(retrieval, "sparse_topk", lambda *a: called.append(a))
    made = retrieval.candidates
    monkeypatch.setattr(retrieval, "candidates", lambda tied, facts: called.append(tied.count()) or made(tied, facts))
    queries = asked.selectExpr("query_id", "query", "CASE WHEN query_id % 2 = 0 THEN 'user' END AS speaker")
    found = retrieval.search_batch(queries, docs, postings, retrieval.hash_vectors(docs), 4).collect()
    assert called == [1] and {x["query_id"] for x in found if x["rank_speaker"]} <= {x[0] for x in rows if x[0] % 10 == 0}
    assert all(x["speaker"] == "user" for x in found if x["query_id"] % 2 == 0)


def test_lanes_are_shared_by_blocks(spark, monkeypatch):
    """Rows before the last ranking do not grow with the lanes of each block; scores are those of double precision."""
    import numpy as np

    r = random.Random(8)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(25)], k=200 if i < 30 else r.randint(0, 6)))) for i in range(400)] + [(400, "w1 " * 9000), (401, "w1 " * 9000), (7, "w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in (*range(25, 60), 400)], "query_id long, query string")
    asked = retrieval.hash_vectors(queries.selectExpr("query_id AS doc_id", "query AS text")).withColumnRenamed("doc_id", "query_id")
    vectors = retrieval.hash_vectors(docs)
    want = {tuple(x) for x in retrieval.sparse_topk(queries, retrieval.token_postings(docs), 5).select("query_id", "doc_id", "score", "rank").collect()}
    tasks, ranked = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda scores, *a: tasks.append(scores.rdd.getNumPartitions()) or ranked(scores, *a))
    monkeypatch.setattr(retrieval, "TEXT_QUERIES", 4)
    monkeypatch.setattr(retrieval, "DENSE_BYTES", 4 * 8 * 384, raising=False)
    monkeypatch.setattr(retrieval, "LANES", 6)
    monkeypatch.setattr(retrieval, "SLICE", 10)
    for found in (retrieval.whole_text_topk(queries, docs, 5), retrieval.postings_topk(queries, retrieval.token_postings(docs), 5)):
        assert {tuple(x) for x in found.select("query_id", "doc_id", "score", "rank").collect()} == want
    dense = {(x[0], x[3]): (x[1], x[2]) for x in retrieval.dense_topk(asked, vectors, 5).select("query_id", "doc_id", "score", "rank").collect()}
    assert len(tasks) == 3 and max(tasks) <= 20  # nine blocks of two lanes at most, some of no query
    units = {x[0]: np.array(x[1], np.float64) / np.linalg.norm(np.array(x[1], np.float64)) for x in vectors.collect()}
    for q in asked.collect():
        unit = np.array(q[1], np.float64) / np.linalg.norm(np.array(q[1], np.float64))
        first = sorted((-round(float(unit @ v), 6), i) for i, v in units.items())[:5]
        assert [dense[q[0], k + 1] for k in range(5)] == [(i, -s) for s, i in first]

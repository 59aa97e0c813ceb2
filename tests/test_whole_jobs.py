"""Registered queries over whole texts and all rows, against brute force."""

import random
import re
from collections import Counter, defaultdict

import __spark_entry__ as entry
from parlance.operators import evaluate, retrieval


def test_cer_distance_has_every_segment_whole(spark, tmp_path):
    texts = ["the sea " * 60, "e" * 250, "x" * 220 + "eee", "où est le café été " * 15, "你好e世界", "", None]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r["seg_idx"]: (r["distance"], r["rate"]) for r in entry.queries()["cer_distance"](spark, f"file://{tmp_path}").collect()}
    want = {}
    for k, text in enumerate(texts):
        ref = text or ""
        distance = evaluate.edit_counts(list(ref), list(ref.replace("e", "ae")))[0]
        want[k] = (distance, round(distance / max(len(ref), 1), 6))
    assert got == want


def test_rank_lists_take_whole_texts_and_every_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "TEXT_QUERIES", 3)
    monkeypatch.setattr(retrieval, "COMMON_TOKENS", 5)
    monkeypatch.setattr(retrieval, "SLICE", 7)
    r = random.Random(5)
    known = [f"w{k}" for k in range(60)] + ["the", "of", "你", "É"]
    rows = [(i, "x " * 40 + " ".join(r.choices(known, k=r.randint(0, 50))), r.choice(["en", "fr"])) for i in range(0, 800, 20)]
    rows += [(40, "the w1 w2", "en"), (900, None, "en"), (1000, "apart", "en"), (None, "w3 w4 the", "en")]
    vectors = [(i, [r.random() for _ in range(4)]) for i in range(0, 400, 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    tokens = defaultdict(Counter)
    for d, text, _ in rows:
        tokens[d].update(re.findall("[a-z0-9]+|[\u4e00-\u9fff]", (text or "").lower()))
    want = {}
    for q in {d for d in tokens if d is not None and d % 100 == 0}:
        scores = [(-sum(n * tokens[d][t] for t, n in tokens[q].items()), d is not None, d or 0, d) for d in tokens]
        want |= {(q, d): k for k, (score, *_, d) in enumerate(sorted(s for s in scores if s[0] < 0)[:20], 1)}
    found = entry.queries()["rrf_search"](spark, f"file://{tmp_path}").collect()
    assert {(x["query_id"], x["doc_id"]): x["rank_keyword"] for x in found if x["rank_keyword"]} == want
    assert {x["query_id"] for x in found if x["rank_semantic"]} == {0, 100, 200, 300}
    assert {x["query_id"] for x in found} == {0, 100, 200, 300, 400, 500, 600, 700, 1000}
    kept = entry.queries()["filtered_search"](spark, f"file://{tmp_path}").collect()
    assert {400, 500, 600, 700, 1000} <= {x["query_id"] for x in kept}

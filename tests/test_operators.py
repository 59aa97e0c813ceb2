"""Rules on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import parsing
from parlance.functions import text as T
from parlance.operators import evaluate, intervals, predicates, sequence
from parlance.sources import transcripts
from parlance.streaming import live


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_text_rules(spark):
    assert one(spark, "哈" * 16, T.clean_hallucination) == "哈哈"
    assert one(spark, "哈" * 15, T.clean_hallucination) == "哈" * 15
    assert one(spark, "你好你好", T.suspicious_repeat) is True
    assert one(spark, "对对对对", T.suspicious_repeat) is False
    assert one(spark, "come come here", T.suspicious_repeat) is True
    assert one(spark, "speaker_3 said", T.parse_speaker) == "SPEAKER_03"
    assert one(spark, "Agree ", T.intent_name) == "同意"
    assert one(spark, "　a b ", T.strip) == "a b"


def test_align(spark):
    seg = spark.createDataFrame([(1, 0, "x", 0, 2000), (2, 0, "x", 0, 2000), (3, 0, "x", 0, 10000), (4, 0, "x", 0, 1000)], "file_id long, seg_idx int, text string, start_ms long, end_ms long").withColumn("speaker", F.lit(None).cast("string"))
    diar = spark.createDataFrame([(1, 0, "A", 0, 800), (1, 1, "B", 800, 2000), (2, 0, "A", 0, 1000), (2, 1, "B", 1000, 2000), (3, 0, "A", 0, 300), (4, 0, "A", 5000, 6000)], "file_id long, diar_idx int, speaker string, start_ms long, end_ms long")
    got = {r["file_id"]: r["speaker"] for r in intervals.align_speakers(seg, diar).collect()}
    assert got == {1: "B", 2: "A", 3: "A", 4: "SPEAKER_UNKNOWN"}
    tiny = intervals.overlap_join(seg, diar, bucket=100).count()
    assert tiny == intervals.overlap_join(seg, diar).count()


def test_sequence(spark):
    rows = [(1, 0, "a", "x", 0, 2000), (1, 1, "a", "y", 1500, 3000), (1, 2, "a", "z", 2900, 3020)]
    seg = spark.createDataFrame(rows, "file_id long, seg_idx int, speaker string, text string, start_ms long, end_ms long")
    assert [(r["start_ms"], r["end_ms"]) for r in sequence.dedupe_boundaries(seg).orderBy("start_ms").collect()] == [(0, 2000), (2040, 3000)]
    same = spark.createDataFrame([(1, k, "a", "t", 1000 * k, 1000 * k + 2000) for k in range(3)], seg.schema)
    assert sorted(r["seg_idx"] for r in sequence.chunk_dedupe(same).collect()) == [0, 2]
    long = spark.createDataFrame([(1, 0, "a", "c" * 170, 0, 10000)], seg.schema)
    assert [len(r["text"]) for r in sequence.presplit(long).orderBy("part_idx").collect()] == [57, 57, 56]
    totals = spark.createDataFrame([(k, t) for k, t in enumerate([30_000, 31_000, 55_000, 56_000])], "file_id long, total_ms long")
    assert [r["count"] for r in sequence.chunk_windows(totals).groupBy("file_id").count().orderBy("file_id").collect()] == [1, 2, 2, 3]


def test_filters(spark):
    rows = [(1, 0, "【music】", 0, 1000), (1, 1, "。。", 0, 1000), (1, 2, "12", 0, 1000), (1, 3, "hi", 0, 11000)]
    seg = spark.createDataFrame(rows, "file_id long, seg_idx int, text string, start_ms long, end_ms long")
    assert [r["seg_idx"] for r in predicates.artifact_filter(seg).collect()] == [2]


def test_edit_counts():
    assert evaluate.edit_counts(list("abc"), list("axcd")) == (2, 1, 1, 0)
    assert evaluate.edit_counts([], list("ab")) == (2, 0, 2, 0)
    assert evaluate.edit_counts(list("kitten"), list("sitting"))[0] == 3


def test_parsing():
    assert parsing.corrections('```json\n{"corrections": [{"index": 2, "text": "a", "note": null},]}\n```') == [(2, "a", None)]
    assert parsing.corrections('{"0": "x"}') == [(0, "x", None)]
    assert parsing.parse_time_range("1:00-2:00") is None
    assert parsing.parse_time_range("1:00~2:00") == (60.0, 120.0)


def test_live():
    assert live.drop_repeated_prefix("hello, world again", "say hello world") == "again"
    out, mark, _ = live.stable_segments([(0.0, 2.0, "first part"), (2.0, 9.5, "late")], 0.0, 6.0, "")
    assert out == [(0.0, 2.0, "first part")] and mark == 2.0


def test_results_and_textgrid(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"files": [{"file": "f", "segments": [{"start": 1.0, "text": "t", "odd": 1}]}]}')
    (tmp_path / "manual_corrected_latest.json").write_text('{"file": "g", "segments": [{"start": 1.0}]}')
    rows = transcripts.explode_segments(transcripts.read_results(spark, f"file://{tmp_path}"), "d").collect()
    assert [(r["file_id"], r["start"], r["end"], r["uid"]) for r in rows] == [("f", 1.0, 1.0, "d/f#0")]
    grid = 'name = "A"\nxmin = 0\nxmax = 1.5\ntext = "hi"\nxmin = 1.5\nxmax = 2\ntext = "<%>"\n'
    assert list(transcripts.parse_textgrid(grid)) == [("A", 0.0, 1.5, "hi")]


@pytest.mark.parametrize("name", ["align_speakers", "merge_turns", "rrf_search"])
def test_entry_queries_run(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_commit_stream(spark, tmp_path):
    rows = [(1, 6.0, [(0.0, 2.0, "first part")]), (1, 12.0, [(0.0, 2.0, "first part"), (2.1, 6.0, "second part"), (7.0, 13.0, "late")]), (2, 20.0, [(1.0, 4.0, "other session")])]
    schema = "session_id long, available_end double, segments array<struct<start:double,`end`:double,text:string>>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run = live.commit_stream(stream).writeStream.format("memory").queryName("commits").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["session_id"], r["text"]) for r in spark.table("commits").collect()) == [(1, "first part"), (1, "second part"), (2, "other session")]


def test_index_round_trip(spark, tmp_path):
    from parlance.operators import retrieval

    docs = spark.createDataFrame([(0, "the quick brown fox"), (1, "a lazy dog"), (2, "no")], "doc_id long, text string")
    retrieval.build_index(docs, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index/segments").count() == 2
    queries = spark.createDataFrame([(0, "brown dog fox")], "query_id long, query string")
    found = retrieval.sparse_topk(queries, spark.read.parquet(f"{tmp_path}/index/postings"), 5).collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(0, 2), (1, 1)]
    with pytest.raises(ValueError):
        retrieval.build_index(docs.where("doc_id = 2"), f"{tmp_path}/none")

"""Editing by hand: the round trip is the identity, edits of the line's form are applied; turns from SQL."""

from collections import Counter

import pytest

from parlance import catalog
from parlance.operators import relations, sequence, turns

SEG = "file_id {}, seg_idx int, speaker string, text string, start_ms long, end_ms long"
ODD = ["A", "A: chair", "Dr. No (left)", "x:y", " spaced ", None, "?", "说话人 1", "[0:1] odd"]
TEXTS = ["hello", "a: b: c", " two\nlines ", "", None, "12:00.0-13:00.0 x: y", "[1:1] a 00:00.0-00:01.0 B: c", "你好。", "tab\tstop"]


def rows_of(kind):
    names = [5, 3, 2**53 + 1] if kind == "long" else ["meeting one.wav", "b/0:1 00:00.0-00:01.0 x: y.json", "z"]
    return [(f, k, ODD[k], t, 61_234 * k, 61_234 * k + 7_000_000 * (k == 3) + 900) for f in names for k, t in enumerate(TEXTS)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_unedited_lines_change_nothing(spark, kind):
    seg = spark.createDataFrame(rows_of(kind), SEG.format(kind))
    out = relations.apply_edits(seg, relations.edit_lines(seg).select("line"))
    assert Counter(tuple(r)[:6] for r in out.select(*seg.columns).collect()) == Counter(rows_of(kind))
    assert relations.edit_changes(out).first()[0] == 0


def test_edits(spark):
    rows = [("a b", 0, "A", "one", 0, 900), ("a b", 1, "A", "two", 1000, 1900), ("c", 0, "B", "three", 0, 900), ("c", 1, "B", "four", 0, 900)]
    seg = spark.createDataFrame(rows, SEG.format("string"))
    lines = ["[0:0] a b 00:00.0-00:00.9 A: ONE", "[1] a b 00:01.0-00:01.9 Guest: two", "[1:0] c 00:00.0-00:00.9 C: Three: 3", "[1:1] c 00:00.0-00:00.9 D:   ", "[7:0] none 00:00.0-00:00.9 B: x", "[1:1] c 0-0.9 B: seconds", "note"]
    out = relations.apply_edits(seg, spark.createDataFrame([(x,) for x in lines], "line string"))
    got = {(r["file_id"], r["seg_idx"]): (r["speaker"], r["text"], r["speaker_original_manual"], r["text_original_asr"]) for r in out.collect()}
    assert got == {("a b", 0): ("A", "ONE", None, "one"), ("a b", 1): ("Guest", "two", "A", None), ("c", 0): ("C", "Three: 3", "B", "three"), ("c", 1): ("B", "four", None, None)}
    assert relations.edit_changes(out).first()[0] == 4


def test_turns_in_sql(spark):
    found = lambda df: Counter(tuple(r) for r in df.select("file_id", "start_ms", "end_ms", "speaker", "text").collect())
    sf = "/root/testdata/sf0.001"
    assert found(catalog.turns_in_sql(spark, sf)) == found(catalog.words_to_turns(spark, sf))
    # overlapping, over-long, blank and nameless words
    rows = [(f, k, w, s, t, t + n) for f in (1, 2) for k, (w, s, t, n) in enumerate([("slowly", "A", 0, 3_000), ("in", "A", 900, 100), (" ", "A", 950, 10), ("ab", "B", 1_000, 2_600), ("x", None, 9_000, 30), ("end", "A", 9_100, 200), ("late", "A", None or 9_350, 0), ("late", "A", 9_400, 300)])]
    words = spark.createDataFrame(rows, "file_id long, word_idx long, word string, speaker string, start_ms long, end_ms long").repartition(3)
    turns.register(spark)
    words.createOrReplaceTempView("some_words")
    assert found(spark.sql("SELECT * FROM turns(TABLE(some_words))")) == found(sequence.words_to_turns(words))
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM turns(TABLE(SELECT 1 AS file_id))").collect()

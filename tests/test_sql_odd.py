"""Registered queries against their SQL on odd rows."""

import __spark_entry__ as entry
import duckdb


def agree(spark, path, name, rows, table="conversations", schema="conv_id long, turn long, role string, text string"):
    """Writes ``rows`` and compares the query with its SQL, duplicates counted; gives the rows."""
    spark.createDataFrame(rows, schema).write.parquet(f"file://{path}/{table}.parquet")
    frame = entry.queries()[name](spark, f"file://{path}")
    key = lambda row: str(tuple(row))
    got = sorted((tuple(r) for r in frame.collect()), key=key)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    found = db.execute(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[name]}) x").fetchall()
    assert got == sorted(found, key=key)
    return got


def test_unreliable_turns_keeps_line_breaks_at_the_ends_of_phrases(spark, tmp_path):
    # "wh.\n" stands twice, and no other phrase does
    texts = ["Onesly is ontihaer ouwh.\nTionshwh.\nErin onhe.", "Onesly is ontihaer ouwh. Tionsh.\nErin onhe.", "\nplainer words\n", "a  b has no other", " ", "\n", "", None, "plain words and morning"]
    rows = [(c, 3 * k + c, role, t) for k, t in enumerate(texts) for c, role in ((0, "user"), (1, None), (2, "user"))]
    got = agree(spark, tmp_path, "unreliable_turns", rows)
    assert (0, 0, "SPEAKER_UNKNOWN") not in got and (0, 3, "SPEAKER_UNKNOWN") in got


def test_low_confidence_finds_repeats_in_one_scan(spark, tmp_path):
    from parlance.functions import text as T

    words = [f"{chr(97 + k % 26)}{k}" for k in range(60)]
    texts = [" ".join(words), "好好好好", "对对对对", "嗯嗯 嗯嗯", "😀a😀a", "ab, ab", "abcabc", "abcdefabcdef", "abcdefgabcdefg", "x yx y", "哈哈哈哈哈", "no no", "a\nb\na\nb", ""]
    agree(spark, tmp_path, "low_confidence", [(1, k, "user", t) for k, t in enumerate(texts)])
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(T.suspicious_repeat("text").alias("r"))
    assert "sequence" not in frame._jdf.queryExecution().toString()  # no n-gram is cut out at each place
    assert frame.collect()[0]["r"] is False and frame.collect()[6]["r"] is True


def test_error_counts_take_texts_and_not_tokens_into_python(spark):
    from parlance.operators import evaluate

    rows = [("a", "the sea is  wide", "the sea was wide wide"), ("b", None, "one two"), ("c", "", None)]
    out = evaluate.error_rates(spark.createDataFrame(rows, "file_id string, ref string, hyp string"))
    assert sorted(tuple(r)[:6] for r in out.collect()) == [("a", 4, 5, 2, 1, 1), ("b", 0, 2, 2, 0, 2), ("c", 0, 0, 0, 0, 0)]
    plan = out._jdf.queryExecution().toString()
    assert "array" not in plan and "split" not in plan
    chinese = evaluate.error_rates(spark.createDataFrame([("a", "你好 世界", "你世界")], "file_id string, ref string, hyp string"), "zh")
    assert tuple(chinese.first())[1:4] == (4, 3, 1)


def test_edit_distance_is_that_of_the_counts(spark):
    import random
    import time

    from parlance.operators import evaluate

    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choices("abcé你", k=r.randint(0, 30))) for _ in range(2))
        b = a.replace("a", "ba", r.randint(0, 5)) if r.random() < 0.4 else b
        assert evaluate.edit_distance(a, b) == evaluate.edit_distance(list(a), list(b)) == evaluate.edit_counts(list(a), list(b))[0]
    text = "".join(r.choices("abcdefghij ", k=60_000))
    frame = spark.createDataFrame([(1, 0, text)], "file_id long, seg_idx long, text string").selectExpr("*", "seg_idx AS start_ms")
    before = time.time()
    row = evaluate.spoken_rates(frame, frame.selectExpr("file_id", "seg_idx", "start_ms", "replace(text, 'e', 'ae') AS text")).first()
    distance = evaluate.character_distance(spark.createDataFrame([(text, text.replace("e", "ae"))], "ref string, hyp string"))
    assert row["cer"] == round(text.strip().count("e") / len(text.strip()), 4) and distance.first()["distance"] == text.count("e")
    assert time.time() - before < 30 and "levenshtein" not in distance._jdf.queryExecution().toString()

"""The model boundary with scripted doubles, and the live path."""

import base64
import datetime
import json
import os
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from parlance.models import clients, dialogue
from parlance.models.answers import AnswerLog
from parlance.sources import audio
from parlance.streaming import live

SEG = "file_id long, seg_idx int, speaker string, text string, start_ms long, end_ms long"


def rows(n, file_id=1):
    return [(file_id, k, "AB"[k % 2], f"text {k}", 1000 * k, 1000 * k + 900) for k in range(n)]


class Upper:
    """Corrects every shown line to capitals and keeps to its numbers."""

    model_name = "upper"

    def chat(self, messages, *, temperature=0.1, max_tokens=4096):
        found = re.findall(r"^\[(\d+)\] (?:\S+ )?\S+: (.*)$", messages[1]["content"], re.M)
        return json.dumps({"segments": [{"index": int(i), "text": t.upper(), "note": "caps"} for i, t in found]})


class Broken:
    model_name = "broken"

    def chat(self, messages, *, temperature=0.1, max_tokens=4096):
        raise OSError("no network")


def test_correction_in_batches(spark):
    data = rows(33) + [(2, 0, "A", "  ", 0, 10), (2, 1, None, "only one", 10, 20)]
    seg = spark.createDataFrame(data, SEG)
    calls = dialogue.correction_calls(seg, "en").orderBy("file_id", "batch").collect()
    assert [(c["file_id"], c["batch"], c["count"]) for c in calls] == [(1, 0, 15), (1, 1, 15), (1, 2, 3), (2, 0, 2)]
    assert "[0] 00:15 B: text 15" in calls[1]["prompt"] and "[1] 00:00 UNKNOWN: only one" in calls[3]["prompt"] and "[0]" not in calls[3]["prompt"]
    got = {(r["file_id"], r["seg_idx"]): r for r in dialogue.correct(seg, Upper, "en").collect()}
    assert len(got) == len(data) and all(got[1, k]["text"] == f"TEXT {k}" and got[1, k]["text_before_llm"] == f"text {k}" for k in range(33))
    assert got[2, 0]["text"] == "  " and got[2, 0]["correction_note"] is None and got[2, 1]["text"] == "ONLY ONE"
    assert {r["text"] for r in dialogue.correct(seg, Broken, "en").collect()} == {r[3] for r in data}


class LoseNumbers(Upper):
    def chat(self, messages, *, temperature=0.1, max_tokens=4096):
        return '{"corrections": [{"index": 0, "text": "编号十二"}, {"index": 1, "text": "今天开会。"}]}'


def test_corrections_that_lose_numbers_are_turned_down(spark):
    seg = spark.createDataFrame([(1, 0, "A", "编号 12 的问题", 0, 1), (1, 1, "A", "今天 开会", 1, 2)], SEG)
    assert [r["text"] for r in dialogue.correct(seg, LoseNumbers).orderBy("seg_idx").collect()] == ["编号 12 的问题", "今天开会。"]


class Tags:
    model_name = "tags"

    def chat(self, messages, *, temperature=0.0, max_tokens=2048):
        return 'here: {"intents": [{"index": 0, "intents": ["question", "nonsense"]}, {"index": 1, "intent": "agree"}, {"index": 2, "intents": ["nonsense"]}, {"index": 77, "intents": ["agree"]}, 5]} ok'


def test_intents(spark):
    got = [r["intent"] for r in dialogue.tag_intents(spark.createDataFrame(rows(23), SEG), Tags, "en").orderBy("seg_idx").collect()]
    assert len(got) == 23 and got[0] == ["question"] and got[1] == ["agree"] and got[2] == ["statement"] and got[20] == ["question"]
    assert {tuple(r["intent"]) for r in dialogue.tag_intents(spark.createDataFrame(rows(3), SEG), Broken, "zh").collect()} == {("陈述",)}
    assert dialogue.intents_of("x", 2, ["d"], None) == [["d"], ["d"]]


class Merge:
    model_name = "merge"

    def chat(self, messages, *, temperature=0.1, max_tokens=2048):
        assert "=== Speaker utterances ===" in messages[1]["content"] and "  - text 0" in messages[1]["content"]
        return '{"merge_suggestions": [{"from": "A", "to": "C"}, {"from": "B", "to": "B"}, {"from": "A", "to": "B"}, {"from": "B", "to": "D"}]}'


def test_consistency(spark):
    seg = spark.createDataFrame(rows(4) + rows(3, 2), SEG)
    got = {(r["file_id"], r["seg_idx"]): (r["speaker"], r["consistency_note"]) for r in dialogue.unify_speakers(seg, Merge, "en").collect()}
    assert got[1, 0] == ("B", "merged A→B") and got[1, 1] == ("D", "merged B→D")  # one pass, the last mapping wins
    assert got[2, 0] == ("A", None)  # under four segments


class Summary:
    model_name = "summary"

    def chat(self, messages, *, temperature=0.3, max_tokens=2048):
        return '{"topic": "t", "key_points": ["a", 2], "decisions": "none", "summary": null}'


def test_summary(spark):
    seg = spark.createDataFrame(rows(3) + [(2, 0, "Z", "", 0, 1)], SEG)
    got = {r["file_id"]: r.asDict() for r in dialogue.summarize(seg, Summary, "en").collect()}
    assert got[1] == {"file_id": 1, "topic": "t", "summary": "", "key_points": ["a", "2"], "decisions": [], "action_items": [], "participants": ["A", "B"]}
    assert got[2]["participants"] == []
    assert dialogue.summary_of("no json", ["A"]) == {"topic": "", "summary": "", "key_points": [], "decisions": [], "action_items": [], "participants": ["A"]}


def test_rolling_context():
    client = clients.Scripted(lambda m: '{"segments": [{"index": 0, "text": "changed"}, {"index": 5, "text": "new"}]}')
    context = dialogue.RollingContext(client, "en", context=5, most=8, keep=4)
    context.history = [{"text": f"h{k}", "speaker": "A"} for k in range(7)]
    out = context.process([{"text": "one", "speaker": "B"}, {"text": "two", "speaker": "B"}])
    assert [s["text"] for s in out] == ["new", "two"] and len(context.history) == 4 and context.history[-2]["text"] == "new"
    assert "h2" in client.asked[0][1]["content"] and "h1" not in client.asked[0][1]["content"]
    assert len(context.window([{}] * 14)) == 15 and context.process([]) == []


def test_clients(tmp_path, monkeypatch):
    seen = []
    apart = clients.SystemApart(lambda *a: seen.append(a) or [{"type": "tool"}, {"type": "text", "text": "hi"}], "m")
    assert apart.chat([{"role": "system", "content": "a"}, {"role": "user", "content": "u"}, {"role": "system", "content": "b"}]) == "hi"
    assert seen[0][1] == "a\nb" and seen[0][2] == [{"role": "user", "content": "u"}]
    assert clients.SystemApart(lambda *a: [], "m").chat([]) == "" and clients.SystemInside(lambda *a: [None], "m").chat([]) == ""
    env = tmp_path / ".env"
    for name in ("ACTIVE_LLM", "DEEPSEEK_API_KEY", "CLAUDE_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    env.write_text("CLAUDE_API_KEY=k\nCLAUDE_MODEL=big\n")
    with pytest.raises(RuntimeError):
        clients.chat_client(lambda b, k: None, env=str(env))
    monkeypatch.setenv("ACTIVE_LLM", "claude")
    made = clients.chat_client(lambda b, k: (b, k), env=str(env))
    assert isinstance(made, clients.SystemApart) and made.model_name == "big" and made.send == ("claude", "k")
    monkeypatch.setenv("ACTIVE_LLM", "other")
    with pytest.raises(ValueError):
        clients.chat_client(lambda b, k: None, env=str(env))


class Loud:
    """Hears one segment wherever the audio is loud, in its own time."""

    loaded = 0

    def load(self):
        Loud.loaded += 1

    def transcribe(self, samples, rate, language=None):
        from parlance.sources.transcripts import energy_regions

        return {"segments": [{"start": round(a, 2), "end": round(b, 2), "text": f"word {k}", "avg_logprob": -0.5} for k, (a, b) in enumerate(energy_regions(samples, rate))] + [{"start": None, "end": None, "text": "untimed"}]}

    def diarize(self, samples, rate):
        return {"segments": [{"start": 1.0, "end": 2.0, "speaker": "B"}, {"start": 0.0, "end": 1.0, "speaker": "A"}]}


def speech(*at, seconds=4.0):
    x = np.zeros(int(seconds * 16_000), np.float32)
    for a, b in at:
        n = int((b - a) * 16_000)
        x[int(a * 16_000) : int(a * 16_000) + n] = 0.5 * np.sin(np.arange(n) / 5)
    return x


def test_recognizers(spark):
    with pytest.raises(ValueError):
        clients.recognizer({"backend": "unknown"})
    with pytest.raises(NotImplementedError):
        clients.recognizer({"backend": "faster-whisper"})
    clients.register_recognizer("transformers", lambda settings, options: (settings, options))
    settings, options = clients.recognizer({"model": "m"})
    assert options.chunk_length_s == 30.0 and options.temperature[-1] == 1.0 and clients.LongForm().beam_size == 5
    clients._MAKERS.pop("transformers")
    files = spark.createDataFrame([("a", bytearray(audio.encode(speech((1, 2)), 16_000))), ("b", bytearray(b"junk"))], "file_id string, content binary")
    got = clients.transcribed(files, Loud).collect()
    assert [(r["file_id"], r["seg_idx"], r["end"]) for r in got if r["text"] == "untimed"] == [("a", 1, 0.0)] and sum(r["problem"] is not None for r in got) == 1
    assert [(r["diar_idx"], r["speaker"], r["num_speakers"]) for r in clients.diarized(files.where("file_id = 'a'"), Loud).collect()] == [(0, "A", 2), (1, "B", 2)]
    words = clients.aligned(spark.createDataFrame([(1, 2, "A", "ab cdef", 0, 600)], SEG)).orderBy("word_idx").collect()
    assert [(w["word_idx"], w["word"], w["start_ms"], w["end_ms"]) for w in words] == [(200_000, "ab", 0, 200), (200_001, "cdef", 200, 600)]


def test_chunks_of_a_file(spark):
    x = speech((1, 2), (8.2, 9.4), (14, 15), seconds=16.0)
    files = spark.createDataFrame([("f", 16_000, x.tolist())], "file_id string, sample_rate int, samples array<float>")
    chunks = live.chunk_results(files, Loud, size=10.0, overlap=2.0)
    assert sorted((r["chunk_index"], r["chunk_start_s"]) for r in chunks.collect()) == [(0, 0.0), (1, 8.0)]
    got = sorted((r["start_ms"], r["text"]) for r in live.merged_chunks(chunks).where("end_ms > start_ms").collect())
    assert [round(s / 1000) for s, _ in got] == [1, 8, 8, 14] or [round(s / 1000) for s, _ in got] == [1, 8, 14]
    with pytest.raises(ValueError):
        live.chunk_results(files, Loud, size=2.0, overlap=2.0)


def test_live_rules():
    window = [{"start": 0.0, "end": 2.0, "text": " first part "}, {"start": 2.0, "end": 2.5, "text": "ok"}, {"start": 2.1, "end": 6.0, "text": "second"}, {"start": 5.9, "end": 9.5, "text": "late"}]
    out, mark, tail = live.stable_rows(window, 0.0, 6.0, "")
    assert [(r["text"], r["playback_start"], r["playback_end"]) for r in out] == [("first part", 0.0, 2.55), ("second", 1.65, 6.55)] and mark == 6.0
    again, mark2, _ = live.stable_rows([{"start": 4.0, "end": 6.3, "text": "short"}, {"start": 2.1, "end": 8.0, "text": "second, and more"}], mark, 11.0, tail)
    assert [(r["start"], r["text"]) for r in again] == [(6.0, ", and more")] and mark2 == 8.0
    assert live.stable_rows(window, 5.0, 8.0, "") == ([], 5.0, "")
    raw, upto = live.raw_increment(window, 0.0, "")
    assert raw == {"start": 0.0, "end": 9.5, "text": "first part ok second late"} and upto == 9.5
    assert live.raw_increment(window, 9.5, "")[0] is None and live.raw_increment([], 0.0, "") == (None, 0.0)
    assert live.raw_increment([{"start": 0.0, "end": 12.0, "text": "second late news"}], 9.5, "first part ok second late")[0]["text"] == "news"
    assert live.drop_repeated_prefix("你好，世界。今天", "大家说：你好世界") == "。今天" and live.drop_repeated_prefix("abc", "xabc") == "abc"


def drained(spark, frame, name, tmp_path):
    # timers of processing time would call for batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    run = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.table(name).collect()


def test_live_path(spark, tmp_path):
    """Messages to chunks to sliding windows to two phases of text."""
    x = speech((1, 2), (3, 5), seconds=8.0)
    sent = [{"type": "init", "session_id": 7}]
    for k in range(4):
        wav = base64.b64encode(audio.encode(x[32_000 * k : 32_000 * (k + 1)], 16_000)).decode()
        sent.append({"type": "audio", "session_id": 7, "chunk_id": k, "data": wav, "ts": f"2024-01-01 00:00:0{k}"})
    sent += [sent[-1], {"type": "audio", "session_id": 7, "chunk_id": 9, "data": base64.b64encode(audio.encode(x[:100], 16_000)).decode(), "ts": "2024-01-01 00:00:08"}, {"type": "audio", "chunk_id": 10, "data": "AAAA", "ts": "2024-01-01 00:00:09"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/m.json").write_text("\n".join(json.dumps(m) for m in sent) + "\nnot json\n")
    messages = live.read_messages(spark, f"file://{tmp_path}/in")
    chunks = drained(spark, live.distinct_chunks(live.audio_chunks(messages)), "chunks", tmp_path)
    assert sorted((r["session_id"], r["chunk_id"], len(r["pcm"])) for r in chunks) == [(7, k, 64_000) for k in range(4)]
    windows = drained(spark, live.sliding_windows(live.audio_chunks(messages), seconds=5.0), "windows", tmp_path)
    assert sorted((r["chunk_id"], r["window_start"], r["available_end"]) for r in windows) == [(0, 0.0, 2.0), (1, 0.0, 4.0), (2, 1.0, 6.0), (3, 3.0, 8.0)]
    stored = spark.createDataFrame(windows).coalesce(1)
    decoded = live.decoded_windows(stored, Loud).withColumn("segments", F.filter("segments", lambda s: s["end"] > s["start"]))
    decoded.write.parquet(f"file://{tmp_path}/decoded")
    stream = spark.readStream.schema(decoded.schema).parquet(f"file://{tmp_path}/decoded")
    out = drained(spark, live.two_phase_stream(stream), "phases", tmp_path)
    commits = sorted((round(r["start"]), round(r["end"])) for r in out if r["phase"] == "asr")
    assert commits == [(1, 2), (3, 5)] and any(r["phase"] == "raw_asr" for r in out)
    answers = [json.loads(r["answer"]) for r in live.acknowledgements(spark.read.text(f"file://{tmp_path}/in").select(F.from_json("value", live.MESSAGE).alias("m")).select("m.*")).collect()]
    assert sorted(a["type"] for a in answers) == ["duplicate"] + ["queued"] * 6 + ["ready"]


def chunk_stream(spark, tmp_path, name, batches):
    """A stream of (session, chunk, second, value) that comes in so many files, one a micro-batch."""
    schema = "session_id long, chunk_id long, ts timestamp, pcm binary"
    path = tmp_path / f"{name}-in"
    for k, rows in enumerate(batches):
        whole = [(s, c, datetime.datetime.fromtimestamp(1_700_000_000 + t, datetime.UTC).replace(tzinfo=None), bytearray(np.full(8_000, v, "<i2").tobytes())) for s, c, t, v in rows]
        spark.createDataFrame(whole, schema).coalesce(1).write.mode("append").parquet(f"file://{path}/{k}")
    files = [f"{path}/{k}" for k in range(len(batches))]
    for k, f in enumerate(files):
        for part in pathlib.Path(f).glob("part*"):
            os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{path}")


def test_chunks_in_any_order(spark, tmp_path):
    sent = [(s, c, c, 10 * s + c) for s in (1, 2) for c in range(8)]
    mixed = sent[:]
    random.Random(2).shuffle(mixed)
    want = None
    for name, rows in (("straight", sent), ("mixed", mixed + mixed[:3])):  # chunks sent twice, too
        stream = chunk_stream(spark, tmp_path, name, [rows[:7], rows[7:12], rows[12:]])
        got = sorted((r["session_id"], r["chunk_id"], r["window_start"], r["available_end"], r["missed"], bytes(r["pcm"])) for r in drained(spark, live.sliding_windows(stream, 1.5), name, tmp_path))
        assert len(got) == 16 and all(r[4] == 0 for r in got)
        want = want or got
        assert got == want


def test_gaps_are_given_up_and_sessions_forgotten(spark, tmp_path):
    # chunk 1 of session 1 never comes in time; every batch is later than all patience
    batches = [[(1, 0, 0, 1), (1, 2, 2, 3)], [(2, 0, 60, 5)], [(1, 1, 61, 2), (2, 1, 62, 6), (1, 3, 62, 4)], [(3, 0, 9_000, 7)], [(1, 0, 9_001, 8)], [(1, 1, 9_030, 9)]]
    stream = chunk_stream(spark, tmp_path, "gaps", batches)
    moment = "1 millisecond"
    got = [(r["session_id"], r["chunk_id"], r["missed"], r["available_end"]) for r in drained(spark, live.sliding_windows(stream, patience=moment, idle=moment), "gaps", tmp_path)]
    assert sorted(got) == [(1, 0, 0, 0.5), (1, 0, 0, 0.5), (1, 1, 0, 1.0), (1, 2, 1, 1.0), (1, 3, 0, 1.5), (2, 0, 0, 0.5), (2, 1, 0, 1.0), (3, 0, 0, 0.5)]


def test_fixed_chunks(spark):
    x = np.arange(10_000, dtype="<i2")
    blocks = [(1, k, bytearray(x[3_200 * k : 3_200 * (k + 1)].tobytes())) for k in range(4)]
    got = live.fixed_chunks(spark.createDataFrame(blocks, "session_id long, block_id long, pcm binary"), 0.25).orderBy("chunk_id").collect()
    assert [len(r["pcm"]) for r in got] == [8_000, 8_000, 4_000] and b"".join(bytes(r["pcm"]) for r in got) == x.tobytes()


def test_merged_table_and_refinement(spark, tmp_path):
    schema = "session_id long, seg_idx int, phase string, text string, end double"
    table = live.MergedTable(spark, f"file://{tmp_path}/t", ["session_id", "seg_idx"], schema)
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert table.read().count() == 0
    table.apply(make([(1, 0, "asr", "a", 1.0), (1, 1, "asr", "b", 2.0)]), 0)
    late = make([(1, 0, "corrected", "A", 1.0), (1, 0, "asr", "z", 9.0), (2, 0, "asr", "c", 1.0)])
    table.apply(late, 1)
    table.apply(late, 1)  # a batch that runs again
    assert sorted((r["session_id"], r["seg_idx"], r["text"]) for r in table.read().collect()) == [(1, 0, "A"), (1, 1, "b"), (2, 0, "c")] and table.batches() == [0, 1]
    offline = make([(1, 0, "asr", "whole", 5.0)])
    assert sorted((r["session_id"], r["phase"], r["text"]) for r in live.refined(table.read(), offline).collect()) == [(1, "refined", "whole"), (2, "asr", "c")]
    recordings = spark.createDataFrame([(1, bytearray(audio.encode(speech((1, 2)), 16_000))), (2, None), (3, bytearray(b"x"))], "session_id long, content binary")
    got = live.refine_recordings(recordings, Loud).collect()
    assert {r["session_id"] for r in got if r["problem"]} == {2, 3} and any(r["text"] == "word 0" for r in got)


def test_batches_write_their_own_rows_and_old_parts_go(spark, tmp_path):
    schema = "session_id long, seg_idx int, phase string, text string, end double"
    table = live.MergedTable(spark, f"file://{tmp_path}/m", ["session_id", "seg_idx"], schema, most=3)
    state = {}
    for batch in range(9):
        rows = [(s, batch % 4, "asr", f"{batch}", 1.0) for s in range(3)]
        table.apply(spark.createDataFrame(rows, schema), batch)
        state |= {r[:2]: r[3] for r in rows}
        assert {(r["session_id"], r["seg_idx"]): r["text"] for r in table.read().collect()} == state
    names = sorted(p.name for p in (tmp_path / "m").iterdir() if "=" in p.name)
    assert names == ["base=3", "base=7", "delta=4", "delta=5", "delta=6", "delta=7", "delta=8"] and table.batches() == [8]
    assert spark.read.parquet(f"file://{tmp_path}/m/delta=8").count() == 3
    # a batch that was cut off before its marker is not seen, and can run again
    spark.createDataFrame([(9, 9, "asr", "half", 1.0, 9)], schema + ", _batch long").write.parquet(f"file://{tmp_path}/m/delta=9")
    assert table.read().where("session_id = 9").count() == 0
    table.apply(spark.createDataFrame([(9, 9, "asr", "whole", 1.0)], schema), 9)
    table.apply(spark.createDataFrame([(9, 9, "asr", "again", 1.0)], schema), 9)
    assert [r["text"] for r in table.read().where("session_id = 9").collect()] == ["whole"]


def test_a_task_that_runs_again_asks_nobody_twice(spark, tmp_path):
    """The first attempt fails after its calls; the second takes the answers from the log."""
    asked_at = tmp_path / "asked"
    asked_at.mkdir()

    class Counting(Upper):
        def chat(self, messages, **settings):
            (asked_at / str(len(list(asked_at.iterdir())))).write_text(messages[1]["content"])
            if "text 31" in messages[1]["content"]:
                raise OSError("line is busy")
            return super().chat(messages)

    log = f"file://{tmp_path}/log"
    seg = spark.createDataFrame(rows(33), SEG).coalesce(1)
    calls = dialogue.correction_calls(seg, "en").coalesce(1)

    def once_failing(batches):
        done = list(batches)
        if not (tmp_path / "failed").exists():
            (tmp_path / "failed").write_text("x")
            raise RuntimeError("lost after the calls")
        yield from done

    answers = dialogue.asked(calls, Counting, "system", 0.1, 4096, log)
    failing = answers.mapInArrow(once_failing, answers.schema)
    with pytest.raises(PythonException, match="lost after the calls"):
        failing.collect()
    assert len(list(asked_at.iterdir())) == 3
    failing = answers.mapInArrow(once_failing, answers.schema)  # a plan that failed stays failed
    got = {r["batch"]: (r["answer"], r["call_error"]) for r in failing.collect()}
    assert len(got) == 3 and got[2] == (None, "OSError: line is busy") and "TEXT 3" in got[0][0]
    prompts = sorted(p.read_text() for p in asked_at.iterdir())
    assert len(prompts) == 4 and len(set(prompts)) == 3  # only the failed call was made again
    kept = AnswerLog(log)
    assert kept.read(spark).count() == 2 and {r["error"] for r in kept.read(spark, "errors").collect()} == {"OSError: line is busy"}
    again = dialogue.correct(seg, Broken, "en", log)  # another model: nothing of the first one's is taken
    assert {r["text"] for r in again.collect()} == {r[3] for r in rows(33)}
